"""Substring dedup of long word sequences by recompression.

The words of a text are rewritten in rounds.  The first names runs of one word; each later round
splits all names into left and right ones by a hash bit and names every pair of a left one followed
by a right one.  Names are hashes of what they replace, so all tasks name alike without meeting, and
equal word sequences get equal symbols but near their ends.  Each symbol carries the stretch of words
that settles it.  A window is represented by the leftmost symbol of the highest round whose stretch
lies in the window whole; if there is none, by itself.  Symbols that stand at several places reveal
the candidates; windows of 20 words are then compared themselves (see ``repeats``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .repeats import RANGES, covered, pieces, repeated_windows, rows_of, settled, window_rows, with_ranges
from .textops import Rolling, mix, text_chunks, word_hashes, words

FAR = np.int64(1) << 40


def _neighbours(values: np.ndarray, opens: np.ndarray, missing: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each symbol the left and the right neighbour's value; ``missing`` beyond the ends of a text."""
    left, right = np.empty_like(values), np.empty_like(values)
    left[1:], right[:-1] = values[:-1], values[1:]
    left[opens] = -missing
    right[np.concatenate([opens[1:], [len(values)]]) - 1] = missing
    return left, right


def symbols(names: np.ndarray, opens: np.ndarray, rounds: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each round, the stretches [low, high) of words that settle its symbols.

    opens: the first place of each (non-empty) text.  What depends on a text's end reaches beyond it."""
    n = len(names)
    if not n:
        return
    fresh = np.zeros(n, bool)
    fresh[opens] = True
    head = np.flatnonzero(fresh | np.concatenate([[True], names[1:] != names[:-1]]))
    size = np.diff(np.append(head, n))
    low, high = head, head + size
    names = np.where(size > 1, mix(names[head] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 11), names[head])
    opens = np.searchsorted(head, opens)
    reach = _neighbours(low, opens, FAR)[0], _neighbours(high, opens, FAR)[1]
    low, high = np.where(reach[0] < 0, -FAR, low - 1), np.where(reach[1] >= FAR, FAR, high + 1)  # a run ends where another word stands
    yield low, high
    for r in range(1, rounds):
        is_left = (mix(names, 20 + r) >> np.uint64(63)).astype(bool)
        last = np.append(opens[1:], len(names)) - 1
        pairs = np.zeros(len(names), bool)
        pairs[:-1] = is_left[:-1] & ~is_left[1:]
        pairs[last] = False
        second = np.zeros(len(names), bool)
        second[1:] = pairs[:-1]
        before, after = _neighbours(low, opens, FAR)[0], _neighbours(high, opens, FAR)[1]
        new_low = np.where(pairs | is_left, low, np.minimum(low, before))
        new_high = np.where(pairs, after, np.where(is_left, np.maximum(high, after), high))
        partner = np.append(names[1:], np.uint64(0))
        new_names = np.where(pairs, mix(names * np.uint64(0xD6E8FEB86659FD93) + partner, 40 + r), names)
        stay = ~second
        opens = (np.cumsum(stay) - 1)[opens]
        names, low, high = new_names[stay], new_low[stay], new_high[stay]
        yield low, high


def _anchors(batches: Iterator[pa.RecordBatch], window: int, rounds: int, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in text_chunks(batch, most_bytes=2 * most):  # a word takes two bytes at least, so only one long text alone is cut
            starts, ends, first = words(data, offsets)
            h = word_hashes(data, starts, ends)
            if len(h) <= most:
                yield from _rows(batch, lo, h, first, 0, window, rounds)
            else:
                for i in range(hi - lo):
                    for a, b in pieces(int(first[i + 1] - first[i]), window, most):
                        yield from _rows(batch, lo + i, h[first[i] + a : first[i] + b], np.array([0, b - a]), a, window, rounds)


def _rows(batch, row, h, first, shift, window, rounds) -> Iterator[pa.RecordBatch]:
    """Anchor rows of texts (first: where each begins, and the end of all) that start ``shift`` words into their documents."""
    size = np.diff(first)
    doc = np.repeat(np.arange(len(size)), np.maximum(size - window + 1, 0))
    at = np.flatnonzero(_whole(first, len(h), window))
    if not len(at):
        return
    rolling = Rolling(h)
    whole = rolling.spans(at, at + window)
    new = np.concatenate([[True], (whole[1:] != whole[:-1]) | (doc[1:] != doc[:-1])])  # a window equal to the one before is found without rows
    at, doc, whole = at[new], doc[new], whole[new]
    key, place = np.zeros(len(at), np.uint64), np.full(len(at), -1, np.int64)
    for level, (low, high) in reversed(list(enumerate(symbols(h, first[:-1][size > 0], rounds), 1))):
        todo = np.flatnonzero(place < 0)
        fits = high - low <= window
        low, high = low[fits], high[fits]
        s = np.searchsorted(low, at[todo])
        ok = s < len(low)
        ok[ok] = high[s[ok]] <= at[todo][ok] + window
        todo, s = todo[ok], s[ok]
        key[todo], place[todo] = rolling.spans(low[s], high[s], 100 + level), level * FAR + low[s]
    rest = place < 0
    key[rest], place[rest] = mix(whole[rest], 3), -2 - at[rest]
    cut = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | (np.diff(at) != 1)]))
    last = np.append(cut[1:], len(at)) - 1
    base = first[doc[cut]]
    yield rows_of(batch, row + doc[cut], key[cut], rolling.spans(at[cut], at[last] + window, 2), at[cut] - base + shift, at[last] - base + shift)


def _whole(first: np.ndarray, n: int, window: int) -> np.ndarray:
    """Places where a window starts that ends within its text."""
    change = np.zeros(n + 1, np.int64)
    fits = np.diff(first) >= window
    np.add.at(change, first[:-1][fits], 1)
    np.add.at(change, first[1:][fits] - window + 1, -1)
    return np.cumsum(change[:-1]) > 0


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        todo, ids = batch.column(2), batch.column(0).to_numpy()
        for lo, hi, data, offsets in text_chunks(batch):
            starts, ends, first = words(data, offsets)
            one, two = Rolling(word_hashes(data, starts, ends)), Rolling(word_hashes(data, starts, ends, 1))
            each = [np.concatenate([np.arange(r["first"], r["last"] + 1) for r in todo[i].as_py()]) for i in range(lo, hi)]
            doc = np.repeat(np.arange(hi - lo), [len(x) for x in each])
            within = np.concatenate(each)
            at = within + first[doc]
            yield window_rows(ids[lo + doc], within, one.spans(at, at + window, 5), two.spans(at, at + window, 6))


def _kept(batches: Iterator[pa.RecordBatch], window: int, as_is: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ranges = batch.column(2)
        for lo, hi, data, offsets in text_chunks(batch):
            starts, ends, first = words(data, offsets)
            h, raw = word_hashes(data, starts, ends), data.tobytes()
            rolling, at = Rolling(h), np.flatnonzero(_whole(first, len(h), window))
            same = np.zeros(len(h), bool)
            if len(at):
                whole = rolling.spans(at, at + window)
                same[at[1:]] = (whole[1:] == whole[:-1]) & (np.diff(at) == 1)
                same[first[:-1][np.diff(first) > 0]] = False
            n, removed, texts, spans = [], [], [], []
            for i in range(lo, hi):
                a, b = first[i - lo], first[i - lo + 1]
                gone = covered([(r["first"], r["last"]) for r in ranges[i].as_py() or ()], window, int(b - a), same[a:b])
                n.append(int(b - a)), removed.append(int(gone.sum()))
                if as_is and not removed[-1]:
                    texts.append(raw[offsets[i - lo] : offsets[i - lo + 1]])
                else:
                    keep = np.flatnonzero(~gone) + a
                    texts.append(b" ".join([raw[x:y] for x, y in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]))
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                spans.append([{"first": int(x), "last": int(y) - 1} for x, y in zip(edge[::2], edge[1::2], strict=True)])
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(texts, pa.binary()).cast(pa.string()), batch.column(3).slice(lo, hi - lo)],
                names=["doc_id", "n_words", "n_removed", "removed", "kept_text", "carried"],
            )


def removed_windows(docs: DataFrame, window: int = 20, rounds: int = 6, most_broadcast_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, ranges of windows whose words also start earlier, but for windows equal to the one just before them."""
    return repeated_windows(docs, lambda b: _anchors(b, window, rounds), lambda b: _windows(b, window), True, most_broadcast_bytes)


def substring_dedup(docs: DataFrame, window: int = 20, rounds: int = 6, most_broadcast_bytes: int = 8 << 20, as_is: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, removed (ranges of words), kept_text (kept words joined by a space),
    carried (a struct of the other columns of ``docs``, whatever their names; absent if there are none).

    A word goes if a window of ``window`` consecutive words of its document covers it whose words also
    start earlier: in a smaller doc_id, or in the same document.  Windows are judged on the input.  With
    ``as_is`` a text that loses nothing is kept with its own white space.  A null or empty text has no
    words and an empty kept_text.  Texts of any length are taken whole; anchors of long ones are found in parts.  Rows that repeat a doc_id and its text get equal results, as one
    document; of different texts under one doc_id that of the smallest hash stands there, the others are documents behind all usual ids.  A row
    with a null doc_id is only compared with itself word by word (its runs of one word go).  An empty
    table gives an empty result.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rows = settled(docs.select("doc_id", "text", F.struct(*(others or [F.lit(0).alias("none")])).alias("carried")), most_broadcast_bytes)
    ranges = removed_windows(rows, window, rounds, most_broadcast_bytes)
    rows = with_ranges(rows, ranges, most_broadcast_bytes).select(F.col("own").alias("doc_id"), "text", "ranges", "carried")
    schema = T.StructType([*T._parse_datatype_string(f"doc_id long, n_words long, n_removed long, {RANGES.replace('ranges', 'removed')}, kept_text string").fields, T.StructField("carried", rows.schema["carried"].dataType)])
    out = rows.mapInArrow(lambda b: _kept(b, window, as_is), schema)
    return out if others else out.drop("carried")
