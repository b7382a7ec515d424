"""Cross-tokenizer alignment: places where tokens of two tokenizers end together, and how often their ids do over the corpus.

A is a byte-level BPE file of the tokenizers library, B a sentencepiece model.  The libraries' spans (character offsets of A, the
proto's byte spans of B) are the coarse cuts.  Tokens that end inside a character, parts of a multibyte character in A and fallback
bytes in B, share its span; they are cut by the lengths of their decoded bytes.  Both runs must add up to the text's bytes.

A text is split before each single space that follows other characters.  Neither tokenizer has a token across such a place (the
vocabulary of B and the split rule of A are checked, else texts stay whole), so what a stretch between two of them gives is
found once and remembered, and a text's result is put together from its stretches.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch

#: White space from a space on, then all up to the next space that follows something else; the last one takes the text's last spaces.
_STRETCH = re.compile(r" \s*(?:\S+(?:[^\S ]\s*)?)*(?: \s*\Z)?")
#: Pairs of at least one 2**20th of all links fit a broadcast whatever the corpus; there are 2**20 of them at most.
HOT = 1 << 20

DIGEST = "row long, doc_id {}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
GROUPS = "doc_id {}, groups array<struct<start:long,end:long,a:array<int>,b:array<int>>>"


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable ones themselves, the others from U+0100 on in order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + k): b for k, b in enumerate(rest)}}


class Ends(NamedTuple):
    """Ids and the bytes at which tokens end; ``exact`` tells whether the decoded tokens are the text."""

    ids: np.ndarray
    ends: np.ndarray
    exact: bool


def refined(ids: np.ndarray, lengths: np.ndarray, coarse: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Ends by the coarse cuts at ``clean`` tokens, and by decoded bytes from the last cut on at the others."""
    decoded = np.cumsum(lengths[ids])
    if clean.all():
        return coarse
    at = np.flatnonzero(clean)
    last = np.searchsorted(at, np.arange(len(ids)), "right") - 1
    base = np.where(last >= 0, coarse[at[last]] if len(at) else 0, 0)
    base_decoded = np.where(last >= 0, decoded[at[last]] if len(at) else 0, 0)
    return base + decoded - base_decoded


class ByteLevel:
    """A: ids and ends of a text by the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        alphabet, entries = byte_alphabet(), self.library.get_vocab(with_added_tokens=True)
        self.size = max(entries.values(), default=-1) + 1
        self.bytes = [b""] * self.size
        for entry, k in entries.items():
            self.bytes[k] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        split, added = self.library.pre_tokenizer, self.library.get_added_tokens_decoder().values()
        plain = repr(split).replace(" ", "").startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in repr(split)
        self.parts_at_spaces = plain and self.library.normalizer is None and all(t.special for t in added)

    def ends(self, text: str, data: bytes) -> Ends:
        found = self.library.encode(text, add_special_tokens=False)
        ids = np.array(found.ids, np.int64)
        spans = np.fromiter(chain.from_iterable(found.offsets), np.int64, 2 * len(ids)).reshape(-1, 2)
        byte_at = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data))
        clean = np.append(spans[1:, 0] >= spans[:-1, 1], True) if len(ids) else np.zeros(0, bool)
        exact = b"".join(map(self.bytes.__getitem__, found.ids)) == data
        return Ends(ids, refined(ids, self.lengths, byte_at[spans[:, 1]], clean), exact)


class Pieces:
    """B: ids and ends of space + text by the sentencepiece library, which adds the space."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(k) for k in range(self.library.get_piece_size())]
        hexed = [re.fullmatch("<0x([0-9A-F]{2})>", p) if self.library.is_byte(k) else None for k, p in enumerate(names)]
        self.bytes = [bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode() for m, p in zip(hexed, names, strict=True)]
        self.size, self.lengths = len(names), np.array([len(b) for b in self.bytes], np.int64)
        unchanged = "a  ①ﬁ Å  b\t　c "  # what usual normalisers change
        kept = b"".join(self.bytes[k] for k in self.library.encode(unchanged)) == b" " + unchanged.encode()
        self.parts_at_spaces = kept and not any(re.search("[^▁][▁ ]|^ ", p) for p in names)

    def ends(self, text: str, data: bytes) -> Ends:
        pieces = self.library.encode(text[1:], return_type="proto").pieces
        found = np.fromiter(chain.from_iterable((p.id, p.begin, p.end) for p in pieces), np.int64, 3 * len(pieces)).reshape(-1, 3)
        ids, spans = found[:, 0], found[:, 1:]
        exact = b"".join(map(self.bytes.__getitem__, ids.tolist())) == data
        return Ends(ids, refined(ids, self.lengths, spans[:, 1] + 1, spans[:, 1] > spans[:, 0]), exact)


class Stretches:
    """What the stretches of texts give, each found once: token and group counts, the groups as text and the linked pairs.

    ``most`` characters are remembered at most, besides those of the texts in hand; then it starts anew."""

    def __init__(self, a_path: str, b_path: str, most: int = 24 << 20):
        self.a, self.b, self.most = ByteLevel(a_path), Pieces(b_path), most
        self.whole = not (self.a.parts_at_spaces and self.b.parts_at_spaces)
        self.shown = [f"{k}{end}" for n, ends in ((self.a.size, ",|"), (self.b.size, ",;")) for end in ends for k in range(n)]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.text: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)  # of A and B tokens, groups; 1 if exact
        self.places = np.zeros(1, np.int64)
        self.pairs = np.zeros(0, np.int64)
        self.weight = 0

    def split(self, text: str) -> Iterator[str]:
        text = " " + text
        if self.whole:
            return iter([text])
        return iter(_STRETCH.findall(text)) if len(text) < 1 << 20 else (m.group() for m in _STRETCH.finditer(text))

    def learn(self, stretches: set[str]) -> None:
        """Stretches are joined into long texts for one call of each library; those that end in white space stay alone, as more text would change them."""
        alone = [s for s in stretches if self.whole or s[-1].isspace() or len(s) > 1 << 16]
        together = list(stretches.difference(alone))
        runs = [[s] for s in alone] + [together[i : i + 4096] for i in range(0, len(together), 4096)]
        counts, pairs = [self.counts], [self.pairs]
        while runs:
            run = runs.pop()
            got = self._aligned(run)
            if got is None:  # one of them isn't exact: each by itself
                runs += [[s] for s in run]
                continue
            for s in run:
                self.known[s] = len(self.known)
                self.weight += len(s) + 40
            self.text += got[0]
            counts.append(got[1])
            pairs.append(got[2])
        self.counts, self.pairs = np.concatenate(counts), np.concatenate(pairs)
        self.places = np.concatenate([[0], np.cumsum(self.counts[:, 2])])

    def _aligned(self, run: list[str]) -> tuple[list[str], np.ndarray, np.ndarray] | None:
        a, b, edges = self.tokens(run)
        common = np.intersect1d(a.ends, b.ends, assume_unique=True)
        if not (a.exact and b.exact and np.isin(edges, common).all()):
            return ([""], np.zeros((1, 4), np.int64), np.zeros(0, np.int64)) if len(run) == 1 else None
        groups = np.searchsorted(common, edges, "right")
        at_a, at_b = np.searchsorted(a.ends, common), np.searchsorted(b.ends, common)  # the tokens that close each group
        shown = np.empty(len(a.ids) + len(b.ids), np.int64)
        place_a = np.arange(len(a.ids)) + np.concatenate([[0], at_b + 1])[np.searchsorted(common, a.ends)]
        place_b = np.arange(len(b.ids)) + (at_a + 1)[np.searchsorted(common, b.ends)]
        shown[place_a], shown[place_b] = a.ids, b.ids + 2 * self.a.size
        shown[place_a[at_a]] += self.a.size
        shown[place_b[at_b]] += self.b.size
        words = list(map(self.shown.__getitem__, shown.tolist()))
        cuts = [0, *(place_b[at_b][groups - 1] + 1).tolist()]
        n_a, n_b = np.searchsorted(a.ends, edges, "right"), np.searchsorted(b.ends, edges, "right")
        counts = np.diff(np.stack([n_a, n_b, groups, np.arange(1, len(run) + 1)], 1), axis=0, prepend=0)
        return ["".join(words[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)], counts, (a.ids[at_a] << 32) | b.ids[at_b]

    def tokens(self, run: list[str]) -> tuple[Ends, Ends, np.ndarray]:
        """Both tokenizers' ends in the joined stretches, and the bytes at which the stretches end."""
        text = "".join(run)
        data = text.encode()
        return self.a.ends(text, data), self.b.ends(text, data), np.cumsum([len(s.encode()) for s in run])


_held: dict[tuple[str, str], Stretches] = {}


def _stretches(a_path: str, b_path: str) -> Stretches:
    """One for each worker, kept from task to task."""
    key = (a_path, b_path)
    if key not in _held:
        _held.clear()
        _held[key] = Stretches(*key)
    return _held[key]


class _Row:
    """A text in the making: counts, the running digest and the pairs so far."""

    def __init__(self):
        self.counts, self.digest, self.held, self.pairs = np.zeros(3, np.int64), hashlib.sha256(), "", []
        self.exact = True

    def add(self, of: Stretches, idx: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> None:
        counts = of.counts[idx]
        self.counts += counts[:, :3].sum(0)
        self.exact = self.exact and bool(counts[:, 3].all())
        joined = self.held + "".join(map(of.text.__getitem__, idx.tolist()))
        self.digest.update(joined[:-1].encode())
        self.held = joined[-1:]
        self.pairs.append((pairs, times))

    def done(self) -> tuple:
        if not self.exact or not self.counts[2]:
            return 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs, times = self.pairs[0]
        if len(self.pairs) > 1:
            pairs, where = np.unique(np.concatenate([p for p, _ in self.pairs]), return_inverse=True)
            times = np.bincount(where, np.concatenate([t for _, t in self.pairs])).astype(np.int64)
        return *self.counts.tolist(), self.digest.hexdigest(), pairs, times


def _slices(texts: list, of: Stretches, most: int) -> Iterator[list[tuple[int, list[str], bool]]]:
    """Groups of (row, stretches, last) of about ``most`` stretches; a longer text is spread over several groups."""
    group, size = [], 0
    for row, text in enumerate(texts):
        if not text:
            group.append((row, [], True))
            continue
        found, room = of.split(text), max(1, (most - size))
        while len(part := list(islice(found, room))) == room:  # as many as the group has room for: it is full
            group.append((row, part, False))
            yield group
            group, size, room = [], 0, most
        group.append((row, part, True))
        size += len(part) + len(text) // 64
        if size >= most:
            yield group
            group, size = [], 0
    yield group


def _digests(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, most: int) -> Iterator[pa.RecordBatch]:
    of, number = _stretches(a_path, b_path), TaskContext.get().partitionId() << 33
    for batch in batches:
        for lo in range(0, len(batch), 1024):
            part = batch.slice(lo, 1024)
            rows: dict[int, _Row] = {}
            out: list[tuple] = []
            for group in _slices(part.column(1).to_pylist(), of, most):
                if of.weight > of.most:
                    of.clear()
                flat = [s for _, stretches, _ in group for s in stretches]
                if new := set(flat).difference(of.known):
                    of.learn(new)
                idx = np.fromiter(map(of.known.__getitem__, flat), np.int64, len(flat))
                sizes = np.array([len(x[1]) for x in group], np.int64)
                links = of.counts[idx, 2]
                which = np.repeat(np.repeat(np.arange(len(group)), sizes), links)
                first = np.repeat(of.places[idx] - np.concatenate([[0], np.cumsum(links)])[:-1], links)
                pairs = of.pairs[first + np.arange(len(first))]
                order = np.lexsort((pairs, which))
                pairs, which = pairs[order], which[order]
                new_run = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]) | (which[1:] != which[:-1])])) if len(pairs) else np.zeros(0, np.int64)
                times = np.diff(np.append(new_run, len(pairs)))
                pairs, edges = pairs[new_run], np.searchsorted(which[new_run], np.arange(len(group) + 1))
                at = 0
                for k, (row, stretches, last) in enumerate(group):
                    made = rows.setdefault(row, _Row())
                    if stretches:
                        made.add(of, idx[at : at + len(stretches)], pairs[edges[k] : edges[k + 1]], times[edges[k] : edges[k + 1]])
                        at += len(stretches)
                    if last:
                        out.append(rows.pop(row).done())
            n_a, n_b, n_groups, digest, pairs, times = zip(*out, strict=True)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in pairs])]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(number, number + len(out)), pa.int64()), part.column(0), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(n_groups, pa.int64()), pa.array(n_groups, pa.int64()),
                    pa.array(digest, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(pairs), pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(times), pa.int32())),
                ],
                names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            )
            number += len(out)


def _texts(docs: DataFrame) -> tuple[DataFrame, str]:
    return docs.select("doc_id", F.col("text").cast("string").alias("text")), docs.schema["doc_id"].dataType.simpleString()


def aligned_groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id and groups: start and end byte in space + text, ids of A and of B between two places where both end.

    Texts that are null, empty or not given back by the tokens have no groups; every row of ``docs`` gives a row."""

    def groups(text: str | None, of: Stretches) -> list[dict]:
        a, b, edges = of.tokens([" " + text]) if text else (None, None, None)
        if not text or not (a.exact and b.exact):
            return []
        out, start, i, j = [], 0, 0, 0
        for end in np.intersect1d(a.ends, b.ends).tolist():
            k, m = (int(np.searchsorted(x.ends, end, "right")) for x in (a, b))
            out.append({"start": start, "end": end, "a": a.ids[i:k].tolist(), "b": b.ids[j:m].tolist()})
            start, i, j = end, k, m
        return out

    def rows(batches):
        of = _stretches(a_path, b_path)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for batch in batches:
            for k in range(len(batch)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([groups(batch.column(1)[k].as_py(), of)], kind)], names=["doc_id", "groups"])

    source, kind = _texts(docs)
    return source.mapInArrow(rows, GROUPS.format(kind))


def link_counts(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """pair, n (links over all rows) and best (whether no pair of the same B id has more), from rows of pairs and times."""
    each = texts.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("x.pairs", "x.times")
    counts = scratch.written(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n")), "link-counts")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def token_alignment(docs: DataFrame, a_path: str, b_path: str, hot: int = HOT, most: int = 400_000) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row for each row of ``docs``.

    Texts that are null, empty or not given back byte for byte by either tokenizer have zeros and ''.  Repeated rows count each time, as
    corpus counts do; rows of one doc_id are apart; an empty table gives an empty one; other columns are ignored.

    Texts are tokenised once; a row's distinct pairs with their counts are written.  Pairs with at least one ``hot``-th of all links,
    at most ``hot`` of them, are looked up in a broadcast table; each rarer one has too few links to make a hot key and is joined by a shuffle."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    source, kind = _texts(docs)
    texts = scratch.written(source.mapInArrow(lambda batches: _digests(batches, a_path, b_path, most), DIGEST.format(kind)), "token-links")
    counts = scratch.written(link_counts(texts, scratch), "link-ranks")
    links = counts.agg(F.sum("n")).first()[0] or 0
    least = max(1, -(-links // hot))
    each = texts.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), "x.times")
    frequent = F.broadcast(counts.filter(F.col("n") >= least))
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    found = each.join(frequent, "pair").groupBy("row").agg(*sums)
    if least > 1:  # else every pair is among the frequent ones
        rare = each.join(frequent, "pair", "left_anti").join(counts.filter(F.col("n") < least), "pair").groupBy("row").agg(*sums)
        found = found.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return texts.drop("pairs", "times").join(found, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
