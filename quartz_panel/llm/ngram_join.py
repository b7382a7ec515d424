"""Jaccard self-join over word n-grams by token-combination prefixes.

A document's tokens are the hashes of its distinct n-word shingles.  All tokens are put in one order:
rare ones first, by hash, then frequent ones.  Two similar sets share a token among their first p, and
k tokens among their first p + k - 1.

* Classes.  Each token that can enter a prefix is counted.  The order visits the lowest part of the
  hash range first (``zone``), so those tokens are counted over all documents; the others are counted
  over the documents whose zone has fewer than p rare tokens, as only these go on to them.  Tokens
  over the threshold are frequent.  They set bits in a table whose size follows their number up to
  2**table_bits; beyond that the threshold rises.  A class changes cost, never results: a bit set by
  chance makes a token frequent for all documents alike.
* Rare tokens are indexed singly: a document with p rare tokens or more needs no others.
* A document with fewer extends its prefix and indexes combinations of frequent tokens.  Small sets
  take all pairs (k = 2) of the extended prefix.  In larger ones all frequent tokens are dealt by hash into
  more cells than similar partners can differ in, so some cells are equal in both (pigeonhole) and each
  cell's tokens are one combination.  Cells depend on the size class; a document indexes its own class
  and the next.
* Documents of the same words are one node before the index.  Blocks of equal keys first link members to
  a leader; large blocks that still hold several components try neighbours in random orders, round
  after round; then only pairs in different components are left.  So a group of m copies costs about m
  verifications.  Parity sketches bound the difference from below and discard pairs exactly.
* Verification is by the words of both texts, not by hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components, with_links
from .store import Scratch, broadcast_if_below
from .textops import LOWER, mix, signed, text_chunks, word_hashes, words

#: longs of the folded sketch that goes along with every key of an open block; what passes it is tried by the whole sketches
NARROW = 8
#: documents of a block in which one order of neighbours is tried by one task
SUB_BLOCK = 500


@dataclass(frozen=True)
class Setting:
    shingle: int = 3
    percent: int = 90  # similarity, as 100 * intersection >= percent * union
    frequent: int = 50  # documents of a token beyond which it is frequent
    zone: int | None = None  # of 256 parts of the hash range; half as much again as a prefix takes by default
    whole: int = 64  # sets up to this size stay whole in the first pass
    pairs: int = 32  # sets up to this size index pairs of frequent tokens, larger ones cells
    table_bits: int = 27

    @property
    def zone_end(self) -> int:
        zone = self.zone or min(128, (100 - self.percent) * 384 // 100 + 1)
        return min(zone << 56, (1 << 64) - 1)

    def difference(self, sizes: int) -> int:
        """Largest symmetric difference of two similar sets with so many tokens together."""
        return sizes * (100 - self.percent) // (100 + self.percent)

    def prefix(self, n: int) -> int:
        return n - self.overlap(n) + 1

    def overlap(self, n: int) -> int:
        """Tokens that a set of n has in common with any similar one, at least."""
        return -(-self.percent * n // 100)

    def size_bounds(self, most: int = 1 << 40) -> np.ndarray:
        """Upper bounds of size classes; similar sets lie in the same class or in neighbours."""
        bounds = [0, 1]
        while bounds[-1] < most:
            bounds.append(max(bounds[-1] + 1, bounds[-1] * 100 // self.percent))
        return np.array(bounds)


def token_sets(batch: pa.RecordBatch, shingle: int) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(row, words joined by spaces, sorted distinct token hashes) of each row; fewer words than ``shingle`` make one token, none make none."""
    for lo, hi, data, offsets in text_chunks(batch):
        data = LOWER[data]
        starts, ends, first = words(data, offsets)
        h, raw = word_hashes(data, starts, ends), data.tobytes()
        grams = h[: max(0, len(h) - shingle + 1)].copy()
        for k in range(1, shingle):
            grams = mix(grams, k) + h[k : k + len(grams)] * np.uint64(2 * k + 1)
        grams = mix(grams, 99)
        for i in range(lo, hi):
            a, b = first[i - lo], first[i - lo + 1]
            joined = b" ".join(raw[offsets[i - lo] : offsets[i - lo + 1]].split())
            if b - a >= shingle:
                yield i, joined, np.unique(grams[a : b - shingle + 1])
            elif b > a:
                yield i, joined, np.frombuffer(hashlib.blake2b(joined, digest_size=8).digest(), np.uint64)
            else:
                yield i, joined, np.zeros(0, np.uint64)


def parity_sketch(tokens: np.ndarray, s: Setting) -> np.ndarray:
    """64 * 2**k bits, NARROW longs at least and eight bits for each token that similar sets may differ in; each token flips one.
    Two sketches differ in no more bits than the sets in tokens."""
    words_ = max(NARROW, 1 << max(0, (8 * s.difference(2 * len(tokens)) - 1) // 64).bit_length())
    bit = (mix(tokens, 4) & np.uint64(64 * words_ - 1)).astype(np.int64)
    odd = np.bincount(bit, minlength=64 * words_) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _lists(of: list[np.ndarray | None]) -> pa.Array:
    size = np.array([0 if x is None else len(x) for x in of], np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), mask=np.array([*(x is None for x in of), False]))
    held = [x for x in of if x is not None]
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(held).view(np.int64) if held else np.zeros(0, np.int64)))


SETS = "doc_id long, n long, digest binary, zone array<long>, rest array<long>, sketch array<long>"


def _sets(batches: Iterator[pa.RecordBatch], s: Setting) -> Iterator[pa.RecordBatch]:
    """One row a text: its tokens in the zone, the others if the set is small, and its sketch."""
    end = np.uint64(s.zone_end)
    for batch in batches:
        rows, n, digests, zone, rest, sketches, held = [], [], [], [], [], [], 0

        def flushed() -> pa.RecordBatch:
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(digests, pa.binary()), _lists(zone), _lists(rest), _lists(sketches)], names=["doc_id", "n", "digest", "zone", "rest", "sketch"])

        for row, joined, tokens in token_sets(batch, s.shingle):
            cut = int(np.searchsorted(tokens, end))
            rows.append(row), n.append(len(tokens)), sketches.append(parity_sketch(tokens, s))
            digests.append(hashlib.blake2b(joined, digest_size=16).digest() if len(tokens) else None)
            zone.append(tokens[:cut]), rest.append(tokens[cut:] if len(tokens) <= s.whole else None)
            held += len(tokens)
            if held > 200_000:
                yield flushed()
                rows, n, digests, zone, rest, sketches, held = [], [], [], [], [], [], 0
        if rows:
            yield flushed()


def _table_bit(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (mix(tokens, 3) >> np.uint64(64 - bits)).astype(np.int64)


def _bits(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bit = _table_bit(batch.column(0).to_numpy().view(np.uint64), bits)
        yield pa.RecordBatch.from_arrays([pa.array(bit >> 6), pa.array(signed(np.uint64(1) << (bit & 63).astype(np.uint64)))], names=["word", "bits"])


def frequent_table(tokens: DataFrame, s: Setting, scratch: Scratch) -> np.ndarray:
    """A bit for each frequent token, 16 to 32 bits a token, 2**table_bits at most; all bits of an empty table are clear."""
    often = scratch.written(tokens.groupBy("token").count().filter(F.col("count") > s.frequent), "frequent")
    by_log = {r[0]: r[1] for r in often.groupBy(F.floor(F.log2("count"))).count().collect()}  # 64 rows at most
    threshold, number = s.frequent, sum(by_log.values())
    while number << 4 > 1 << s.table_bits:  # too many for the table: only tokens of more documents are called frequent
        low = min(by_log)
        number -= by_log.pop(low)
        threshold = max(threshold, (2 << low) - 1)
    bits = max(16, (number << 4).bit_length())
    bits = min(bits, s.table_bits)
    got = often.filter(F.col("count") > threshold).select("token").mapInArrow(lambda b: _bits(b, bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    if got.num_rows:
        table[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    scratch.drop(often)
    return table


def is_frequent(tokens: np.ndarray, table: np.ndarray) -> np.ndarray:
    bit = _table_bit(tokens, len(table).bit_length() + 5)
    return ((table[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def combinations(several: np.ndarray, n: int, rare: int, s: Setting, bounds: np.ndarray) -> np.ndarray:
    """Keys over the frequent tokens of a set of n with fewer rare ones than its prefix has places."""
    keys, own = [], int(np.searchsorted(bounds, n))
    for level in (own, own + 1):
        if bounds[level] <= s.pairs:
            if level == own:
                k = min(2, s.overlap(n))
                first = several[: s.prefix(n) + k - 1 - rare]
                i, j = np.triu_indices(len(first), k - 1)
                keys.append(mix(mix(first[i], 7) + first[j], 2000) if k == 2 else mix(first, 2001))
            continue
        cells = s.difference(2 * int(bounds[level])) + 2
        cell = (mix(several, 5) % np.uint64(cells)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        begin = np.flatnonzero(np.diff(cell[order], prepend=-1))
        if len(begin):
            whole = np.add.reduceat(mix(several[order], 6), begin)
            keys.append(mix(whole + cell[order[begin]].astype(np.uint64), 10_000 + level))
        if cells - len(begin) >= 2:  # two cells are equal at least; they may be empty ones
            empty = np.flatnonzero(np.bincount(cell, minlength=cells) == 0).astype(np.uint64)
            i, j = np.triu_indices(len(empty), 1)
            keys.append(mix(empty[i] * np.uint64(cells) + empty[j], 20_000 + level))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


KEYS = "doc_id long, keys array<long>, combined long, short boolean"


def _zone_keys(batches: Iterator[pa.RecordBatch], table: np.ndarray, s: Setting) -> Iterator[pa.RecordBatch]:
    """Keys of documents that have a prefix of rare tokens in the zone; the others are marked as short."""
    for batch in batches:
        keys, short = [], []
        for n, zone in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            tokens = zone.values.to_numpy().view(np.uint64)
            rare = tokens[~is_frequent(tokens, table)][: s.prefix(n)] if n else tokens
            short.append(bool(n) and len(rare) < s.prefix(n))
            keys.append(np.zeros(0, np.uint64) if short[-1] else mix(rare, 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), _lists(keys), pa.array(np.zeros(len(keys), np.int64)), pa.array(short)], names=["doc_id", "keys", "combined", "short"])


def _all_keys(batches: Iterator[pa.RecordBatch], zone_table: np.ndarray, table: np.ndarray, s: Setting) -> Iterator[pa.RecordBatch]:
    """Keys of documents from all their tokens: rare ones singly, and combinations where those are too few."""
    bounds, end = s.size_bounds(), np.uint64(s.zone_end)
    for batch in batches:
        keys, combined = [], []
        for row in batch.column(1):
            tokens = row.values.to_numpy().view(np.uint64)
            cut = int(np.searchsorted(tokens, end))
            often = np.concatenate([is_frequent(tokens[:cut], zone_table), is_frequent(tokens[cut:], table)])
            p = s.prefix(len(tokens))
            rare = tokens[~often][:p]
            more = combinations(tokens[often], len(tokens), len(rare), s, bounds) if len(rare) < p else rare[:0]
            keys.append(np.concatenate([mix(rare, 1), more]))
            combined.append(len(more))
        yield pa.RecordBatch.from_arrays([batch.column(0), _lists(keys), pa.array(combined, pa.int64()), pa.array(np.zeros(len(keys), bool))], names=["doc_id", "keys", "combined", "short"])


def _tokens(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, held, size = [], [], 0
        for row, _, tokens in token_sets(batch, shingle):
            rows.append(row), held.append(tokens)
            size += len(tokens)
            if size > 200_000:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), _lists(held)], names=["doc_id", "tokens"])
                rows, held, size = [], [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), _lists(held)], names=["doc_id", "tokens"])


def indexed(reps: DataFrame, texts, s: Setting, scratch: Scratch) -> DataFrame:
    """doc_id, keys, combined (how many of them are combinations), short: a written table.  ``texts(ids)`` gives doc_id, text of those ids."""
    spark = reps.sparkSession
    zone_table = spark.sparkContext.broadcast(frequent_table(reps.select(F.explode("zone").alias("token")), s, scratch))
    simple = scratch.written(reps.select("doc_id", "n", "zone").mapInArrow(lambda b: _zone_keys(b, zone_table.value, s), KEYS), "keys")
    short = simple.filter("short").select("doc_id")
    if short.isEmpty():
        return simple
    from_set = reps.filter("rest is not null").join(short, "doc_id", "left_semi").select("doc_id", F.concat("zone", "rest").alias("tokens"))
    long_ids = scratch.written(reps.filter("rest is null").select("doc_id").join(short, "doc_id", "left_semi"), "short-ids")
    from_text = texts(long_ids).mapInArrow(lambda b: _tokens(b, s.shingle), "doc_id long, tokens array<long>").dropDuplicates(["doc_id"])
    whole = scratch.written(from_set.unionByName(from_text), "whole-sets")
    end = F.lit(signed(np.array([s.zone_end], np.uint64))[0].item())
    flip = lambda c: c.bitwiseXOR(F.lit(-(1 << 63)))  # noqa: E731  unsigned order
    outside = whole.select(F.explode("tokens").alias("token")).filter(flip(F.col("token")) >= flip(end))
    table = spark.sparkContext.broadcast(frequent_table(outside, s, scratch))
    more = whole.mapInArrow(lambda b: _all_keys(b, zone_table.value, table.value, s), KEYS)
    out = scratch.written(simple.filter("not short").unionByName(more), "keys")
    scratch.drop(simple, long_ids, whole)
    return out


def _names(seqs: list[list[int]], size: int, shingle: int) -> list[np.ndarray]:
    """Distinct shingles of sequences of word numbers below ``size``: equal numbers for equal word runs, without hashing."""
    seqs = [np.array(x, np.int64) for x in seqs]
    grams, most = seqs, size
    for k in range(1, shingle):
        if most * size >= 1 << 62:
            number = np.unique(np.concatenate(grams), return_inverse=True)[1]
            cut, most = len(grams[0]), len(number)
            grams = [number[:cut], number[cut:]]
        grams = [g[:-1] * size + x[k:] for g, x in zip(grams, seqs, strict=True)]
        most *= size
    return [np.unique(g) for g in grams]


def linked(x: bytes, y: bytes, s: Setting) -> bool:
    """Whether two texts link, by their words themselves.  (bytes.lower and bytes.split know A-Z and the six white bytes alone.)"""
    a, b = x.lower().split(), y.lower().split()
    if min(len(a), len(b)) < s.shingle:
        return a == b
    number: dict[bytes, int] = {}
    a, b = ([number.setdefault(w, len(number)) for w in v] for v in (a, b))
    p, q = _names([a, b], len(number), s.shingle)
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= s.percent * (len(p) + len(q) - both)


def _verified(batches: Iterator[pa.RecordBatch], s: Setting) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [linked(bytes(x.as_buffer()), bytes(y.as_buffer()), s) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _may_link(n1: Column, s1: Column, n2: Column, s2: Column, s: Setting) -> Column:
    """False only where sizes or sketches rule the pair out.  Of sketches of unequal length the longer is folded."""
    width = F.least(F.size(s1), F.size(s2))
    word = lambda x, i: F.get(x, i).bitwiseXOR(F.coalesce(F.get(x, i + width), F.lit(0).cast("long")))
    differ = F.aggregate(F.sequence(F.lit(0), width - 1), F.lit(0), lambda acc, i: acc + F.bit_count(word(s1, i).bitwiseXOR(word(s2, i))))
    fits = (100 * F.least(n1, n2) >= s.percent * F.greatest(n1, n2)) & (F.greatest(F.size(s1), F.size(s2)) <= 2 * width)
    return F.when(fits, differ * (100 + s.percent) <= (n1 + n2) * (100 - s.percent)).otherwise(False)


class _Join:
    def __init__(self, docs: DataFrame, s: Setting, most_broadcast_bytes: int):
        self.docs, self.s, self.most = docs.select("doc_id", "text"), s, most_broadcast_bytes
        self.scratch = Scratch(docs.sparkSession)

    def run(self) -> DataFrame:
        s, keep, c = self.s, self.scratch, F.col
        sets = keep.written(self.docs.mapInArrow(lambda b: _sets(b, s), SETS), "sets")
        # rows that share a doc_id are one document: its words are those of the row with the smallest digest
        own = keep.written(sets.select("doc_id", "n"), "rows")
        named = sets.filter("doc_id is not null")
        self.nodes = keep.written(named.groupBy("doc_id").agg(F.min(F.struct("digest", "n")).alias("of")).select("doc_id", "of.*"), "nodes")
        self.unique = self.nodes.count() == named.count()
        classes = keep.written(self.nodes.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")), "classes")
        reps = named.join(classes, ["doc_id", "digest"], "left_semi")
        reps = keep.written(reps if self.unique else reps.dropDuplicates(["doc_id"]), "reps")
        keep.drop(sets)
        self.sketches = reps.select("doc_id", "n", "sketch")
        index = indexed(reps, self.texts, s, keep)
        postings = index.select("doc_id", F.explode(F.array_distinct("keys")).alias("key"))
        shared = postings.groupBy("key").agg(F.min("doc_id").alias("leader"), F.count("*").alias("members")).filter("members > 1")
        blocks = keep.written(postings.join(shared, "key"), "blocks")
        keep.drop(index)

        led = blocks.filter("doc_id <> leader").groupBy("doc_id", "leader").count().groupBy("doc_id").agg(F.max(F.struct("count", -c("leader"))).alias("best"))
        links = self.linking(led.select((-c("best")["col2"]).alias("a"), c("doc_id").alias("b")))
        parts = connected_components(links, keep)
        keep.drop(links)
        blocks, parts = self.closed(blocks, parts)
        more = self.remaining(blocks)
        if not more.isEmpty():
            parts = with_links(parts, more, keep)
        keep.drop(reps)

        of_class = classes.select("digest", c("doc_id").alias("node")).join(parts, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
        of_doc = self.nodes.join(of_class, "digest", "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("component_id"))
        return own.withColumnRenamed("n", "own").join(of_doc, "doc_id", "left").select("doc_id", F.coalesce("n", "own").alias("n_shingles"), "component_id")

    def texts(self, ids: DataFrame) -> DataFrame:
        """doc_id, text of the ids; of rows that share a doc_id the one that stands for it (repeats of it stay)."""
        found = self.docs.join(broadcast_if_below(ids, 32, self.most), "doc_id", "left_semi")
        if self.unique:
            return found
        with_digest = found.mapInArrow(_with_digest, "doc_id long, text string, digest binary")
        return with_digest.join(self.nodes, (with_digest["doc_id"] == self.nodes["doc_id"]) & with_digest["digest"].eqNullSafe(self.nodes["digest"]), "left_semi").drop("digest")

    def linking(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that link, by size, sketch and then the words of their texts: a written table."""
        s, keep = self.s, self.scratch
        tried = keep.written(pairs.select("a", "b"), "tried-pairs")
        ids = keep.written(tried.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "tried-ids")
        sketches = self.sketches.join(broadcast_if_below(ids, 32, self.most), "doc_id", "left_semi")
        x, y = (sketches.select(F.col("doc_id").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in "ab")
        near = tried.join(x, "a").join(y, "b").filter(_may_link(F.col("na"), F.col("sa"), F.col("nb"), F.col("sb"), s))
        pairs = keep.written(near.select("a", "b").distinct(), "pairs")
        keep.drop(tried, ids)
        needed = keep.written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "needed")
        texts = self.texts(needed)
        texts = keep.written(texts if self.unique else texts.dropDuplicates(["doc_id"]), "texts")
        one, two = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
        out = keep.written(pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y").mapInArrow(lambda b: _verified(b, s), "a long, b long"), "verified")
        keep.drop(pairs, needed, texts)
        return out

    def still_open(self, blocks: DataFrame, parts: DataFrame) -> DataFrame:
        """key, doc_id, members, part of blocks that hold several components: a written table."""
        known = blocks.join(parts.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("key", "doc_id", "members", F.coalesce("component", "doc_id").alias("part"))
        known = self.scratch.written(known, "known")
        several = known.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most")).filter("least <> most").select("key")
        out = self.scratch.written(known.join(several, "key"), "open-blocks")
        self.scratch.drop(known)
        return out

    def closed(self, blocks: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Try neighbours of different components in the large open blocks, in another order each round, until a round links few."""
        keep, n = self.scratch, 0
        todo = self.still_open(blocks, parts)
        keep.drop(blocks)
        while True:
            large = todo.filter(F.col("members") > self.s.frequent).withColumn("order", F.xxhash64(F.lit(n), "doc_id"))
            if large.isEmpty():
                return todo, parts
            sub = F.pmod(F.xxhash64(F.lit(-n), "doc_id"), F.ceil(F.col("members") / SUB_BLOCK))
            before = Window.partitionBy("key", sub).orderBy("order", "doc_id")
            pairs = large.select("doc_id", "part", F.lag("doc_id").over(before).alias("other"), F.lag("part").over(before).alias("other_part")).filter("part <> other_part")
            tried = keep.written(pairs.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct(), "neighbours")
            found = self.linking(tried)
            n_tried, n_found = tried.count(), found.count()
            keep.drop(tried)
            if n_found:
                before, parts = parts, with_links(parts, found, keep)
                rest = self.still_open(todo, parts)
                keep.drop(todo, before)
                todo = rest
            keep.drop(found)
            if 20 * n_found <= n_tried:
                return todo, parts
            n += 1

    def remaining(self, blocks: DataFrame) -> DataFrame:
        """Links among all pairs of different components that still meet in a block."""
        s, c = self.s, F.col
        fold = lambda i: F.aggregate(F.sequence(F.lit(i), F.size("sketch") - 1, F.lit(NARROW)), F.lit(0).cast("long"), lambda acc, k: acc.bitwiseXOR(F.get("sketch", k)))
        sketches = self.sketches.select("doc_id", "n", *(F.when(F.size("sketch") > NARROW, fold(i)).otherwise(F.get("sketch", F.lit(i))).alias(f"s{i}") for i in range(NARROW)))
        rows = self.scratch.written(blocks.select("key", "doc_id", "part").join(sketches, "doc_id"), "open-sketches")
        x, y = (rows.select("key", *(c(v).alias(f"{v}_{k}") for v in rows.columns if v != "key")) for k in "ab")
        fits = 100 * F.least("n_a", "n_b") >= s.percent * F.greatest("n_a", "n_b")
        differ = sum((F.bit_count(c(f"s{i}_a").bitwiseXOR(c(f"s{i}_b"))) for i in range(NARROW)), F.lit(0))
        near = fits & (differ * (100 + s.percent) <= (c("n_a") + c("n_b")) * (100 - s.percent))
        tried = x.join(y, (x["key"] == y["key"]) & (c("doc_id_a") < c("doc_id_b")) & (c("part_a") != c("part_b")) & near)
        out = self.linking(self.scratch.written(tried.select(c("doc_id_a").alias("a"), c("doc_id_b").alias("b")).distinct(), "tried"))
        self.scratch.drop(rows, blocks)
        return out


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        joined = [b" ".join(bytes(x.as_buffer()).lower().split()) if x.is_valid else b"" for x in batch.column(1)]
        digest = [hashlib.blake2b(x, digest_size=16).digest() if x else None for x in joined]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digest, pa.binary())], names=["doc_id", "text", "digest"])


def ngram_jaccard_join(docs: DataFrame, setting: Setting | None = None, most_broadcast_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), a row for each row of ``docs``.

    A-Z are lower-cased; words end at white space.  Documents link when 100 * intersection >= percent *
    union of their shingle sets.  A null or empty text has no shingles and links with nothing.  A null
    doc_id links with nothing and has a null component.  Rows that share a doc_id are one document: repeats
    get equal results, and of different texts the one whose words have the smallest digest counts (no words
    come first).  Texts of any length are taken whole: a task holds one batch of texts, or one text and the
    hashes of its words.  Other columns are ignored, whatever their names.  An empty table gives an empty result.
    """
    return _Join(docs, setting or Setting(), most_broadcast_bytes).run()
