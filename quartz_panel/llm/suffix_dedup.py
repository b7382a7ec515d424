"""Exact substring dedup of bytes: every string of 200 bytes that also starts elsewhere is removed.

The suffixes that matter are those a long repeat can begin at; they are sampled first.  Each window of
200 bytes has one sample, the place in it whose next 50 bytes have the least hash, so equal windows
have equal samples, about one in 75 bytes.  Sample suffixes are named by those bytes and sorted by
Spark's external sort; what is decided for a sample is induced for the windows around it: rows with
equal surroundings decide for all their windows at once, the rest are cut into blocks of windows and
decided again, and what is still open is resolved window by window (see ``repeats``).  Why this and not full suffix tuples in priority queues is in the README.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import RANGES, covered, pieces, repeated_windows, rows_of, settled, window_rows, with_ranges
from .substring_dedup import _whole
from .textops import Rolling, byte_values, mix, text_chunks

MOST = 1 << 20


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i : i + width] for each i, from minima up to and from the ends of blocks."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.concatenate([values, np.full(-len(values) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _anchors(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in text_chunks(batch, most_bytes=MOST):
            if len(data) <= 2 * MOST:
                yield from _rows(batch, lo, data, offsets, 0, window, gram)
            else:
                for i in range(hi - lo):
                    for a, b in pieces(int(offsets[i + 1] - offsets[i]), window, MOST):
                        yield from _rows(batch, lo + i, data[offsets[i] + a : offsets[i] + b], np.array([0, b - a]), a, window, gram)


def _rows(batch, row, data, first, shift, window, gram) -> Iterator[pa.RecordBatch]:
    at = np.flatnonzero(_whole(first, len(data), window))
    if not len(at):
        return
    rolling = Rolling(byte_values(data))
    places = np.arange(len(data) - gram + 1)
    named = rolling.spans(places, places + gram)
    # the hash decides, then the place: the leftmost
    least = sliding_least((named & np.uint64(0xFFFFFFFFFF000000)) | places.astype(np.uint64), window - gram + 1)[at]
    sample = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    whole = (data[at[1:] - 1] != data[at[1:] + window - 1]) | (np.diff(at) != 1)
    one = np.concatenate([[True], whole | (data[at[1:]] != data[at[1:] - 1])])
    if not one.all():  # perhaps a run of one byte: compare such windows with the one before
        doubt = np.flatnonzero(~one)
        one[doubt] = rolling.spans(at[doubt], at[doubt] + window) != rolling.spans(at[doubt] - 1, at[doubt] - 1 + window)
    at, sample = at[one], sample[one]
    cut = np.flatnonzero(np.concatenate([[True], (sample[1:] != sample[:-1]) | (np.diff(at) != 1)]))
    last = np.append(cut[1:], len(at)) - 1
    doc = np.searchsorted(first, at[cut], "right") - 1
    yield rows_of(
        batch, row + doc, mix(named[sample[cut]], 9), rolling.spans(at[cut], at[last] + window, 2), at[cut] - first[doc] + shift, at[last] - first[doc] + shift
    )


def _samples(data: np.ndarray, rolling: Rolling, at: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The sampled place of each window that starts at ``at``."""
    places = np.arange(len(data) - gram + 1)
    named = rolling.spans(places, places + gram)
    return (sliding_least((named & np.uint64(0xFFFFFFFFFF000000)) | places.astype(np.uint64), window - gram + 1)[at] & np.uint64(0xFFFFFF)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], window: int, gram: int, block: int) -> Iterator[pa.RecordBatch]:
    """Open rows cut into blocks of windows at fixed distances from their sample.

    A block's key is the hash of the bytes that all of its windows have in common: if that is alone, none of them repeats."""
    for batch in batches:
        todo = batch.column(2)
        for lo, hi, data, offsets in text_chunks(batch, most_bytes=MOST):
            for i in range(lo, hi):  # one text at a time, in parts if it is long
                text = data[offsets[i - lo] : offsets[i - lo + 1]]
                ranges = todo[i].as_py()
                wanted = np.concatenate([np.arange(r["first"], r["last"] + 1) for r in ranges])
                for a, b in pieces(len(text), window, MOST):
                    at = wanted[(wanted >= a) & (wanted + window <= b)] - a
                    if b < len(text):
                        at = at[at < MOST]
                    if not len(at):
                        continue
                    rolling = Rolling(byte_values(text[a:b]))
                    sample = _samples(text[a:b], rolling, at, window, gram)
                    k = (sample - at) // block
                    cut = np.flatnonzero(np.concatenate([[True], (sample[1:] != sample[:-1]) | (k[1:] != k[:-1]) | (np.diff(at) != 1)]))
                    last = np.append(cut[1:], len(at)) - 1
                    q, k = sample[cut], k[cut]
                    core = rolling.spans(q - k * block, q - np.minimum(k * block + block - 1, window - gram) + window, 7)
                    yield rows_of(batch, np.full(len(cut), i), mix(core + k.astype(np.uint64), 8), rolling.spans(at[cut], at[last] + window, 2), at[cut] + a, at[last] + a)


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        todo, ids = batch.column(2), batch.column(0).to_numpy()
        for lo, hi, data, offsets in text_chunks(batch, most_bytes=MOST):
            values = byte_values(data)
            one, two = Rolling(values), Rolling(mix(values, 77))
            each = [np.concatenate([np.arange(r["first"], r["last"] + 1) for r in todo[i].as_py()]) for i in range(lo, hi)]
            doc = np.repeat(np.arange(hi - lo), [len(x) for x in each])
            within = np.concatenate(each)
            at = within + offsets[doc]
            yield window_rows(ids[lo + doc], within, one.spans(at, at + window, 5), two.spans(at, at + window, 6))


def _kept(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    for batch in batches:
        ranges = batch.column(2)
        for lo, hi, data, offsets in text_chunks(batch):
            size, spans, kept = [], [], []
            for i in range(lo, hi):
                text = data[offsets[i - lo] : offsets[i - lo + 1]]
                also = None
                if len(text) > window:  # windows of one byte alone: each has its neighbour
                    edge = np.flatnonzero(np.diff(text))
                    ends = np.append(edge + 1, len(text))
                    begins = np.concatenate([[0], edge + 1])
                    if (long := np.flatnonzero(ends - begins > window)).size:
                        also = np.zeros(len(text), bool)
                        for r in long:
                            also[begins[r] : ends[r] - window + 1] = True
                found = [(r["first"], r["last"]) for r in ranges[i].as_py() or ()]
                size.append(len(text))
                if not found and also is None:
                    spans.append([])
                    kept.append(text.tobytes())
                    continue
                gone = covered(found, window, len(text), also)
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                spans.append([{"first": int(x), "last": int(y) - 1} for x, y in zip(edge[::2], edge[1::2], strict=True)])
                kept.append(text[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])


def suffix_dedup(docs: DataFrame, window: int = 200, gram: int = 50, block: int = 8, most_broadcast_bytes: int = 8 << 20, most_ranges_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, removed (ranges of bytes), kept (the other bytes; they need not be UTF-8).

    A byte goes if a string of ``window`` bytes of its document covers it that also starts at another
    place, in any document; overlaps count.  Null texts are empty.  Rows that repeat a doc_id and its
    text count as one document and get equal results; different texts under one doc_id are documents of their own; a row with a null doc_id is compared with nothing but its own
    runs of one byte.  An empty table gives an empty result; other columns are ignored.  Ranges beyond ``most_ranges_bytes`` aren't sent to
    all tasks, the texts that have any are shuffled to them: what is shuffled is in proportion to the input from small ones on.
    """
    rows = settled(docs.select("doc_id", "text"), most_broadcast_bytes)
    ranges = repeated_windows(rows, lambda b: _anchors(b, window, gram), lambda b: _windows(b, window), False, most_broadcast_bytes, lambda b: _blocks(b, window, gram, block), most_ranges_bytes)
    rows = with_ranges(rows, ranges, most_broadcast_bytes, most_ranges_bytes=most_ranges_bytes).select(F.col("own").alias("doc_id"), "text", "ranges")
    return rows.mapInArrow(lambda b: _kept(b, window), f"doc_id long, n_bytes long, {RANGES.replace('ranges', 'removed')}, kept binary")
