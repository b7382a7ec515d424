"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of all test items, run once over each text.

Items and texts are normalised alike: A-Z are lower-cased, words are runs of ASCII letters and digits and of characters beyond
ASCII.  The automaton's letters are the numbers of the items' words, so a text is read word by word, a window costs a state for
each of its words, and a match says which words it covers.  Those places are mapped back to character offsets of the text as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch

#: Bytes to what they count as: letters, digits and bytes beyond ASCII themselves, A-Z lower-cased, the rest a space.
FOLD = bytes(b if b > 0x7F or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))
_SOLID = np.frombuffer(FOLD, np.uint8) != 0x20

OUT = "n_words long, n_hit long, items array<string>, spans array<struct<first_word:long,last_word:long,start:long,end:long>>"


def folded_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


class Windows:
    """The automaton of a block of items: (item id, texts) each; all windows of ``size`` words, a shorter text is one window."""

    def __init__(self, items: list[tuple[str | None, list[str | None]]], size: int):
        import ahocorasick

        self.words: dict[bytes, int] = {}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        self.length: list[int] = []
        self.owners: list[list[str]] = []
        numbers: dict[tuple[int, ...], int] = {}
        for item, texts in items:
            for text in texts:
                ids = [self.words.setdefault(w, len(self.words) + 1) for w in folded_words(text)]
                for i in range(max(len(ids) - size, 0) + 1 if ids else 0):
                    window = tuple(ids[i : i + size])
                    k = numbers.setdefault(window, len(numbers))
                    if k == len(self.length):
                        self.machine.add_word(window, k)
                        self.length.append(len(window))
                        self.owners.append([])
                    if item is not None and (not self.owners[k] or self.owners[k][-1] != item):
                        self.owners[k].append(item)
        if numbers:
            self.machine.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Maximal runs (first, last) of covered words, and the numbers of the windows that occur."""
        runs: list[tuple[int, int]] = []
        found: set[int] = set()
        if not self.length or not words:
            return runs, found
        for last, k in self.machine.iter(tuple(map(self.words.get, words, [0] * len(words)))):
            first = last - self.length[k] + 1
            found.add(k)
            while runs and runs[-1][1] >= first - 1:
                first = min(first, runs.pop()[0])
            runs.append((first, last))
        return runs, found

    def items(self, found: set[int]) -> list[str]:
        return sorted({item for k in found for item in self.owners[k]})


def spans(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """The runs with their character offsets in ``text``."""
    if not runs:
        return []
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    solid = np.concatenate([[False], _SOLID[data], [False]])
    starts, ends = np.flatnonzero(solid[1:] & ~solid[:-1]), np.flatnonzero(solid[:-1] & ~solid[1:])
    character = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters begun before a byte
    return [{"first_word": a, "last_word": b, "start": int(character[starts[a]]), "end": int(character[ends[b]])} for a, b in runs]


_built: dict[str, Windows] = {}


def _windows(key: str, block, size: int) -> Windows:
    """The block's automaton, built once by each worker; earlier ones go."""
    if key not in _built:
        _built.clear()
        _built[key] = Windows(block.value, size)
    return _built[key]


def _scanned(batches: Iterator[pa.RecordBatch], key: str, block, size: int, hits_only: bool, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    windows = _windows(key, block, size)
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        keep, n_words, n_hit, items, where = [], [], [], [], []
        for i in range(len(column)):
            text = column[i].as_py()
            words = folded_words(text)
            runs, found = windows.scan(words)
            if runs or not hits_only:
                keep.append(i)
                n_words.append(len(words))
                n_hit.append(sum(b - a + 1 for a, b in runs))
                items.append(windows.items(found))
                where.append(spans(text, runs))
        kept = batch.take(pa.array(keep, pa.int64()))
        carried = [kept.column(kept.schema.get_field_index(f.name)) for f in out if f.name in batch.schema.names]
        new = [n_words, n_hit, items, where]
        yield pa.RecordBatch.from_arrays([*carried, *(pa.array(x, f.type) for x, f in zip(new, list(out)[len(carried) :], strict=True))], schema=out)


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, list[str | None]]]]:
    """Items in blocks of at most ``block_bytes`` of text, dealt by hash; an item larger than that is a block alone."""
    size = F.aggregate("texts", F.lit(0).cast("long"), lambda n, t: n + F.coalesce(F.octet_length(t), F.lit(0)) + 16)
    n, most, rows = 1, None, items.withColumn("bytes", size).withColumn("key", F.xxhash64("item", "texts"))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    n = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    while n > 1:
        most = rows.groupBy(F.pmod("key", F.lit(n)).alias("b")).agg(F.sum("bytes").alias("s"), F.count("*").alias("c")).filter(f"c > 1 and s > {block_bytes}").limit(1).count()
        if not most:
            break
        n *= 2
    for b in range(n):
        part = rows.filter(F.pmod("key", F.lit(n)) == b).orderBy("item").select("item", "texts").toArrow().to_pylist()
        if part or n == 1:
            yield [(x["item"], x["texts"]) for x in part]


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, item_id: str = "item_id", texts: tuple[str, ...] = ("text",), block_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as sorted strings) and spans (words and character offsets), a row for each row of ``docs``.

    ``texts`` names the item columns that are searched (a question and its answer, say), each by itself.  A null or empty text has
    no words and no hits, and a null or empty item no windows.  An item without an id covers words but isn't counted; rows of one id
    are one item.  Repeated documents give repeated rows, an empty table an empty one; other columns are ignored.

    Items up to ``block_bytes`` of text make one automaton and documents are read once, without a shuffle.  More items make several
    automata: each reads the documents once and returns those it hits, and these are united by (doc_id, digest of the text)."""
    spark, out = docs.sparkSession, "doc_id {}, " + OUT
    table = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.array(*(F.col(f"`{c}`").cast("string") for c in texts)).alias("texts")).distinct()
    blocks = _blocks(table, block_bytes)
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, "

    def scan(frame: DataFrame, block, head: str, hits_only: bool) -> DataFrame:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_string

        shared, key, schema = spark.sparkContext.broadcast(block), uuid.uuid4().hex, head + OUT
        arrow = to_arrow_schema(_parse_datatype_string(schema))
        return frame.mapInArrow(lambda batches: _scanned(batches, key, shared, size, hits_only, arrow), schema)

    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return scan(source, first, ddl, False)

    scratch, parts, number = Scratch(spark), [], 0
    keyed = source.withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    block = first
    while block is not None:
        found = scan(keyed, block, ddl + "digest binary, ", True).groupBy("doc_id", "digest").agg(F.first("items").alias("items"), F.first("spans").alias("spans"))
        parts.append(scratch.written(found, f"leaks-{number}"))
        block, second, number = second, next(blocks, None), number + 1
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    hits = hits.groupBy("doc_id", "digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    merged = F.aggregate("spans", F.expr("cast(array() as array<struct<first_word:long,last_word:long,start:long,end:long>>)"), _joined)
    hits = hits.withColumn("spans", merged)
    counted = keyed.select("doc_id", "digest", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long").alias("n_words"))
    same = (counted.digest == hits.digest) & counted.doc_id.eqNullSafe(hits.doc_id)
    n_hit = F.aggregate(F.coalesce(hits.spans, F.array()), F.lit(0).cast("long"), lambda n, s: n + s["last_word"] - s["first_word"] + 1)
    return counted.join(hits, same, "left").select(counted.doc_id, "n_words", n_hit.alias("n_hit"), F.coalesce(hits["items"], F.array().cast("array<string>")).alias("items"), F.coalesce(hits.spans, F.array().cast(hits.schema["spans"].dataType)).alias("spans"))


def _joined(done, run):
    """``done`` with the next run by first word, united with the last one where they touch."""
    last = F.element_at(done, -1)
    grown = F.struct(
        last["first_word"].alias("first_word"),
        F.greatest(last["last_word"], run["last_word"]).alias("last_word"),
        last["start"].alias("start"),
        F.greatest(last["end"], run["end"]).alias("end"),
    )
    touch = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["last_word"] >= run["first_word"] - 1)
    return F.when(touch, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(run)))

