"""Token counts by a public tokenizer file, with overlapping chunks for huge documents.

A byte-level BPE file splits a text into pieces from left to right and merges inside each piece, so
the count of a text is the sum over its pieces.  A piece is counted by the library itself, once per
task, and remembered.  A huge text is scanned in overlapping chunks.  The scan keeps no state but
its place, so from a boundary that both chunks' scans have, and that the end of the earlier chunk
can't have moved, the later chunk's pieces are those of the whole text: the two are spliced there.
If the overlap has no such boundary it is doubled, at last to the whole rest of the text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Letters, digits and white space up to U+02C1, and the split pattern of byte-level BPE.
_LETTERS, _NUMBERS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ˁ", "0-9²³¹¼-¾", r"\t-\r\x20\x85\xa0"
_NEAR = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
_FAR = re.compile("[^\x00-ˁ]")


def splitter():
    """Function from a text to the compiled pattern that splits it: the quick one where all characters allow it."""
    import public_tokenizers
    import regex

    full = regex.compile(public_tokenizers.PATTERN)
    return lambda text: full if _FAR.search(text) else _NEAR


class PieceCounter:
    """Tokens of a piece, as the library gives them; ``most`` pieces are remembered, then it starts anew."""

    def __init__(self, tokenizer, most: int = 400_000):
        self.tokenizer, self.most, self.known = tokenizer, most, {}

    def learn(self, pieces) -> dict:
        if len(self.known) > self.most:
            self.known = {}
        if new := [p for p in set(pieces) if p not in self.known]:
            for i in range(0, len(new), 4096):
                part = new[i : i + 4096]
                self.known.update(zip(part, map(len, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        return self.known

    def total(self, pieces: list[str]) -> int:
        return sum(map(self.learn(pieces).__getitem__, pieces))


def _scan(text: str, pattern, start: int, end: int) -> list[int]:
    """Ends of the pieces of text[start:end], scanned as if the text began and ended there."""
    return [start + m.end() for m in pattern.finditer(text[start:end])]


def spliced_pieces(text: str, pattern, chunk: int, overlap: int) -> Iterator[list[str]]:
    """The pieces of ``text`` from scans of overlapping chunks of ``chunk`` characters, a list for each splice."""
    size = len(text)
    end, at = min(size, chunk), 0  # at: a boundary of the whole text; what lies before it has been given
    bounds = _scan(text, pattern, 0, end)
    while True:
        if end == size:
            cut = [b for b in bounds if b > at]
            yield [text[a:b] for a, b in zip([at, *cut], cut, strict=False)]
            return
        fixed = bounds[-3] if len(bounds) > 2 else at  # more text after the chunk can move later ones only
        own, wide, meet = {b for b in bounds if at < b <= fixed}, overlap, None
        while meet is None:
            start = end - wide
            if start <= at:  # no common boundary in all the overlap there can be: a longer chunk from the last sure one
                start = meet = at
                new_end = min(size, end + max(chunk, 2 * wide))
                later = _scan(text, pattern, start, new_end)
            else:
                new_end = min(size, end + max(chunk, wide))
                later = _scan(text, pattern, start, new_end)
                settled = new_end if new_end == size else later[-3] if len(later) > 2 else start
                meet = next((b for b in later if start < b <= settled and b in own), None)
                wide *= 2
        if cut := [b for b in bounds if at < b <= meet]:
            yield [text[a:b] for a, b in zip([at, *cut], cut, strict=False)]
        bounds, end, at = [b for b in later if b > meet], new_end, meet


def _special_strings(tokenizer) -> list[str]:
    return sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)


def counted(batches: Iterator[pa.RecordBatch], path: str, limit: int, chunk: int, overlap: int, group: int = 128) -> Iterator[pa.RecordBatch]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    by_pieces, specials = type(tokenizer.pre_tokenizer).__name__ == "ByteLevel" and tokenizer.normalizer is None, _special_strings(tokenizer)
    special = re.compile("|".join(map(re.escape, specials))) if specials else None
    pattern_of, pieces_of = splitter(), PieceCounter(tokenizer)

    def pieces(text: str) -> Iterator[list[str]]:
        pattern = pattern_of(text)
        if len(text) <= chunk:
            yield pattern.findall(text)
        else:
            yield from spliced_pieces(text, pattern, chunk, overlap)

    def count(text: str) -> int:
        if not by_pieces:
            return len(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0])
        if special is None or not special.search(text):
            return sum(map(pieces_of.total, pieces(text)))
        parts = special.split(text)
        return len(parts) - 1 + sum(pieces_of.total(p) for part in parts if part for p in pieces(part))

    for batch in batches:
        texts = batch.column(1)
        for lo in range(0, len(texts), group):
            part = [t or "" for t in texts.slice(lo, group).to_pylist()]
            n = [count(t) for t in part]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, group), pa.array([len(t.encode()) for t in part], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, chunk: int = 65_536, overlap: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), a row for each row of ``docs``; no shuffle.

    A null text counts as empty: 0 bytes, 0 tokens.  Repeated rows give repeated rows, an empty table an
    empty one; columns other than doc_id and text are ignored.  Special strings inside texts become
    their special token, the library's default.  Files that aren't byte-level BPE without a normaliser
    are counted by one library call for each text, as their pieces depend on each other.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda batches: counted(batches, tokenizer_path, limit, chunk, overlap), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
