"""Windows of a fixed length that occur again somewhere, found from sampled places.

A sampler gives every window one sampled place, which depends on nothing outside the window, so equal
windows have equal places in them.  Consecutive windows with one place form a row: ``key`` (hash of
what the place stands for), ``content`` (hash of all that the row's windows span), doc_id, first and
last window.  Rows whose key is alone are done.  Of the others

* rows with equal content are equal window by window, so one row decides for all of its windows;
* one row of each different content under a key goes on to single windows, compared by 128 bits of two
  independent hashes.

Hot keys.  Rows are combined before they are shuffled: of equal rows of one chunk of texts the first
stands for all, the others are decided there and then and are dealt at random.  A key with many
different contents in one chunk is mixed for certain: its rows are dealt by key and content, one marker
row tells the other rows of the key, and all of them go on to single windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch, broadcast_if_below, written
from .textops import mix, signed

#: place: first window << SPAN_BITS | windows after it; one number, as these rows are the bulk of what is shuffled
SPAN_BITS = 20
ANCHOR_SCHEMA = "key long, content long, doc_id long, place long, state byte"
WINDOW_SCHEMA = "h1 long, h2 long, doc_id long, first long, state byte"
#: bits of ``state``: an equal row of the chunk comes before this one; equal rows of the chunk come after it; a marker; dealt by key and content
AGAIN, TWICE, MARK, APART = 1, 2, 4, 8
#: different contents of a key in one chunk beyond which its rows are dealt by key and content
MANY = 16
RANGES = "ranges array<struct<first:long,last:long>>"
RANGE_TYPE = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def pieces(size: int, window: int, most: int) -> Iterator[tuple[int, int]]:
    """Parts of a long text such that each window lies in one of them whole."""
    at = 0
    while True:
        end = min(size, at + most + window - 1)
        yield at, end
        if end == size:
            return
        at += most


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for ranges in batch.column(1):
            values = ranges.values
            a, b = values.field("first").to_numpy(), values.field("last").to_numpy()
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            cut = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1] + 1]))
            out.append([{"first": int(x), "last": int(y)} for x, y in zip(a[cut], b[np.concatenate([cut[1:], [len(b)]]) - 1], strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, RANGE_TYPE)], names=["doc_id", "ranges"])


def by_document(rows: DataFrame, name: str, most_broadcast_bytes: int, scratch: Scratch) -> DataFrame:
    """doc_id, ranges (merged): a written table."""
    grouped = rows.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("ranges")).mapInArrow(_merged, f"doc_id long, {RANGES}")
    return scratch.written(grouped, name)


def _small(ranges: DataFrame, most_broadcast_bytes: int) -> bool:
    return (ranges.agg(F.sum(64 + 16 * F.size("ranges"))).first()[0] or 0) <= most_broadcast_bytes


def _has(bit: int) -> Column:
    return F.col("state").bitwiseAND(F.lit(bit).cast("byte")) != 0


def _decided(rows: DataFrame, keep_first: bool, name: str, scratch: Scratch) -> DataFrame:
    """doc_id, first, last, sure, open of rows whose key isn't alone: a written table."""
    mark = _has(MARK)
    rows = rows.repartition("key")  # before the columns below are added, so that they aren't shuffled
    rows = rows.select("key", "content", "doc_id", "place", "state", F.when(~mark, F.struct("doc_id", "place")).alias("here"), F.when(~mark, F.col("content")).alias("held"))
    rows = rows.withColumns({"apart": mark | _has(APART), "twice": _has(TWICE)})
    # the wider partitions come first, so that one shuffle and one sort serve both
    key, alike = Window.partitionBy("key"), Window.partitionBy("key", "content")
    rows = rows.withColumns({"low": F.min("held").over(key), "high": F.max("held").over(key), "split": F.max("apart").over(key)})
    rows = rows.withColumns({"lo": F.min("here").over(alike), "hi": F.max("here").over(alike), "several": F.max("twice").over(alike)})
    again, opening = (F.col("lo") != F.col("hi")) | F.col("several"), F.col("lo") == F.col("here")
    mixed = (F.col("low") != F.col("high")) | F.col("split")
    first = F.shiftright("place", SPAN_BITS)
    last = first + F.col("place").bitwiseAND(F.lit((1 << SPAN_BITS) - 1))
    sure = _has(AGAIN) | (~opening if keep_first else again)
    rows = rows.select("doc_id", "place", "state", sure.alias("sure"), (opening & mixed & ~_has(AGAIN)).alias("open"))
    return scratch.written(rows.filter(~_has(MARK)).filter("sure or open").select("doc_id", first.alias("first"), last.alias("last"), "sure", "open"), name)


def with_ranges(texts: DataFrame, ranges: DataFrame, most_broadcast_bytes: int, inner: bool = False, most_ranges_bytes: int | None = None) -> DataFrame:
    """``texts`` with the ranges of their doc_id.  If the ids with ranges are few enough to be sent, other texts aren't shuffled.

    No text is if the ranges themselves are: up to ``most_ranges_bytes``, by default as much as of ids."""
    if _small(ranges, most_broadcast_bytes if most_ranges_bytes is None else min(most_ranges_bytes, most_broadcast_bytes)):
        return texts.join(F.broadcast(ranges), "doc_id", "inner" if inner else "left")
    if ranges.count() * 16 > most_broadcast_bytes:
        return texts.join(ranges, "doc_id", "inner" if inner else "left")
    ids = F.broadcast(ranges.select("doc_id"))
    hit = texts.join(ids, "doc_id", "left_semi").join(ranges, "doc_id")
    return hit if inner else hit.unionByName(texts.join(ids, "doc_id", "left_anti").withColumn("ranges", F.lit(None).cast(ranges.schema["ranges"].dataType)))


def settled(docs: DataFrame, most_broadcast_bytes: int) -> DataFrame:
    """doc_id, text and the other columns of ``docs`` with ``own``, the doc_id as it was.

    Where different texts share a doc_id, that of the smallest hash keeps it; each other text gets a doc_id of its own, made of both and
    behind usual ones, so that it counts as a later document.  Equal texts of one doc_id stay one document."""
    text, own = F.xxhash64(F.coalesce("text", F.lit(""))), F.col("doc_id")
    shared = written(docs.filter("doc_id is not null").select("doc_id", text.alias("h")).groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").select(own.alias("shared_id"), "lo"), "shared-ids")
    rows = docs.withColumn("own", own)
    if shared.isEmpty():
        return rows
    rows = rows.join(broadcast_if_below(shared, 32, most_broadcast_bytes), own == F.col("shared_id"), "left")
    other = F.xxhash64("doc_id", text, F.lit("own document")).bitwiseOR(F.lit(1 << 62)).bitwiseAND(F.lit((1 << 63) - 1))
    return rows.withColumn("doc_id", F.when(F.col("lo") != text, other).otherwise(own)).drop("shared_id", "lo")


def repeated_windows(docs: DataFrame, anchors: Callable, windows: Callable, keep_first: bool, most_broadcast_bytes: int, blocks: Callable | None = None, most_ranges_bytes: int | None = None) -> DataFrame:
    """doc_id, ranges of windows that occur again; with ``keep_first``, of those that occur earlier
    (smaller doc_id, or the same and an earlier start).  Rows that repeat a doc_id count once.

    ``blocks`` splits open rows into blocks of windows, decided in the same way before single windows are."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.filter("doc_id is not null").select("doc_id", "text")
    rows = _decided(texts.mapInArrow(anchors, ANCHOR_SCHEMA), keep_first, "repeats", scratch)
    tables, sure = [rows], rows.filter("sure").select("doc_id", "first", "last")
    todo = by_document(rows.filter("open"), "open", most_broadcast_bytes, scratch)
    if blocks:
        cut = with_ranges(texts, todo, most_broadcast_bytes, True, most_ranges_bytes).select("doc_id", "text", "ranges").mapInArrow(blocks, ANCHOR_SCHEMA)
        rows = _decided(cut, keep_first, "blocks", scratch)
        scratch.drop(todo)
        tables.append(rows)
        sure = sure.union(rows.filter("sure").select("doc_id", "first", "last"))
        todo = by_document(rows.filter("open"), "open", most_broadcast_bytes, scratch)
    single = with_ranges(texts, todo, most_broadcast_bytes, True, most_ranges_bytes).select("doc_id", "text", "ranges").mapInArrow(windows, WINDOW_SCHEMA)
    single = single.repartition("h1", "h2")
    here = F.struct("doc_id", "first")
    equal = Window.partitionBy("h1", "h2")
    single = single.withColumn("lo", F.min(here).over(equal)).withColumn("hi", F.max(here).over(equal)).withColumn("several", F.max(_has(TWICE)).over(equal))
    gone = here != F.col("lo") if keep_first else (F.col("lo") != F.col("hi")) | F.col("several")
    found = single.filter(_has(AGAIN) | gone).select("doc_id", "first", F.col("first").alias("last"))
    out = by_document(sure.union(found), "repeated", most_broadcast_bytes, scratch)
    scratch.drop(todo, *tables)
    return out


def _combined(name: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state of each row of a chunk, and its name: rows of equal names but the first (by doc, at) are told so and get names of their own.
    Rows of one place, which a repeated document gives, stay as they are."""
    state = np.zeros(len(name), np.int8)
    by_name = np.argsort(name, kind="stable")
    same = name[by_name[1:]] == name[by_name[:-1]]
    if not same.any():
        return state, name
    rows = by_name[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    rows = rows[np.lexsort((at[rows], doc[rows], name[rows]))]
    head = np.flatnonzero(np.concatenate([[True], name[rows[1:]] != name[rows[:-1]]]))
    first = np.repeat(rows[head], np.diff(np.append(head, len(rows))))
    other = (doc[rows] != doc[first]) | (at[rows] != at[first])
    state[rows[other]] |= AGAIN
    state[first[other]] |= TWICE
    name = name.copy()
    name[rows[other]] = mix(mix(doc[rows[other]].astype(np.uint64), 31) + at[rows[other]].astype(np.uint64), 32)
    return state, name


def rows_of(batch: pa.RecordBatch, row: np.ndarray, key: np.ndarray, content: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """Anchor rows of a chunk: equal ones combined, keys of many contents dealt apart.  key, content: unsigned."""
    doc = batch.column(0).to_numpy()[row]
    place = first << SPAN_BITS | last - first
    both = mix(mix(key, 33) + content, 34)
    state, name = _combined(both, doc, place)
    again = state & AGAIN != 0
    key = np.where(again, name, key)
    own = np.flatnonzero(~again)
    own = own[np.argsort(key[own], kind="stable")]
    head = np.flatnonzero(np.concatenate([[True], key[own[1:]] != key[own[:-1]]])) if len(own) else own
    many = np.diff(np.append(head, len(own))) > MANY
    marks = key[own[head[many]]]
    apart = own[np.repeat(many, np.diff(np.append(head, len(own))))]
    key[apart] = both[apart]
    state[apart] |= APART
    n = len(marks)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(signed(np.concatenate([key, marks]))),
            pa.array(signed(np.concatenate([content, np.zeros(n, np.uint64)]))),
            pa.array(np.concatenate([doc, np.zeros(n, np.int64)])),
            pa.array(np.concatenate([place, np.zeros(n, np.int64)])),
            pa.array(np.concatenate([state, np.full(n, MARK, np.int8)])),
        ],
        names=["key", "content", "doc_id", "place", "state"],
    )


def window_rows(doc: np.ndarray, at: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> pa.RecordBatch:
    """Rows of single windows of a chunk, equal ones combined."""
    state, name = _combined(mix(mix(h1, 35) + h2, 36), doc, at)
    h1 = np.where(state & AGAIN != 0, name, h1)
    return pa.RecordBatch.from_arrays([pa.array(signed(h1)), pa.array(signed(h2)), pa.array(doc), pa.array(at), pa.array(state)], names=["h1", "h2", "doc_id", "first", "state"])


def covered(ranges, window: int, size: int, also: np.ndarray | None = None) -> np.ndarray:
    """Which of ``size`` places lie in a window of the ranges (first, last), or in those that start where ``also`` is set."""
    change = np.zeros(size + 1, np.int64)
    for a, b in ranges:
        change[a] += 1
        change[b + window] -= 1
    if also is not None:
        at = np.flatnonzero(also)
        np.add.at(change, at, 1)
        np.add.at(change, at + window, -1)
    return np.cumsum(change[:-1]) > 0
