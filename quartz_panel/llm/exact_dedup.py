"""Exact dedup by a log-structured merge index of digests, in DataFrame operations only.

* A task's rows are its memtable: digests are sorted and flushed as one sorted run, a Parquet file
  with a Bloom filter and minimum/maximum statistics on the digest.  Flushing shuffles nothing.
* Compaction merges runs into one run of (digest, smallest id, largest id, count).  Partial
  aggregation comes before the shuffle, so a digest that a third of all rows share is one row a task.
* A digest counted twice or more is a hit.  Rows with a hit are grouped by digest *and bytes*, again
  with partial aggregation; texts that only share a digest come out as different groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import broadcast_if_below, new_table_path, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z lower-cased, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def flush(docs: DataFrame, index_path: str, digest=sha256_digest, filter_ndv: int = 20_000) -> None:
    """Append the documents to the index as sorted runs (level 0)."""
    (
        docs.select(digest(normalised(F.col("text"))).alias("digest"), F.col("doc_id").alias("smallest"), F.col("doc_id").alias("largest"), F.lit(1).cast("long").alias("n"))
        .sortWithinPartitions("digest")
        .write.mode("append")
        .option("parquet.bloom.filter.enabled#digest", "true")
        .option("parquet.bloom.filter.expected.ndv#digest", str(filter_ndv))
        .parquet(f"{index_path}/level=0")
    )


def runs(spark: SparkSession, index_path: str, level: int) -> DataFrame:
    return spark.read.parquet(f"{index_path}/level={level}")


def compact(spark: SparkSession, index_path: str, level: int = 0) -> DataFrame:
    """Merge the runs of a level into the next level; returns that."""
    (
        runs(spark, index_path, level)
        .groupBy("digest")
        .agg(F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), F.sum("n").alias("n"))
        .sortWithinPartitions("digest")
        .write.mode("overwrite")
        .option("parquet.bloom.filter.enabled#digest", "true")
        .parquet(f"{index_path}/level={level + 1}")
    )
    return runs(spark, index_path, level + 1)


def probe(docs: DataFrame, index: DataFrame, digest=sha256_digest) -> DataFrame:
    """The documents whose digest an index has already: candidates for byte verification."""
    return docs.withColumn("__digest", digest(normalised(F.col("text")))).join(index.select(F.col("digest").alias("__digest")), "__digest", "left_semi").drop("__digest")


def exact_dedup(docs: DataFrame, keep: str = "largest", digest=sha256_digest, most_broadcast_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept for each row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.  ``keep`` is
    "largest" or "smallest" doc_id of a group.  Rows repeated with the same doc_id can't be told
    apart: each carries the group's result, and ``deduplicated`` keeps one of them.  A null doc_id is kept only where its whole group has
    none.  An empty table gives an empty result; columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    path = new_table_path(spark, "digest-index")
    flush(docs, path, digest)
    entries, index = runs(spark, path, 0), compact(spark, path)
    pick = F.max if keep == "largest" else F.min
    rows = docs.select("doc_id", normalised(F.col("text")).alias("norm")).withColumn("digest", digest(F.col("norm")))

    def by_bytes(these: DataFrame) -> DataFrame:
        return these.groupBy("digest", "norm").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))

    hits = broadcast_if_below(index.filter("n > 1").select("digest"), 64, most_broadcast_bytes)
    found = written(by_bytes(rows.join(hits, "digest", "left_semi")).select("digest", "keep_id", "group_size"), "digest-hits")
    found = found.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.min("group_size").alias("group_size"), F.count("*").alias("n_texts"))
    found = written(found, "digest-groups")
    clean = broadcast_if_below(found.filter("n_texts = 1").drop("n_texts"), 96, most_broadcast_bytes)
    own = entries.select(F.col("smallest").alias("doc_id"), "digest")
    mixed = found.filter("n_texts > 1").select("digest")
    several = not mixed.isEmpty()
    if several:  # texts share a digest but not their bytes
        own = own.join(mixed, "digest", "left_anti")
    out = own.join(clean, "digest", "left").select("doc_id", "digest", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))
    if several:
        odd = rows.join(mixed, "digest", "left_semi")
        out = out.unionByName(odd.join(by_bytes(odd), ["digest", "norm"]).select("doc_id", "digest", "keep_id", "group_size"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def deduplicated(docs: DataFrame, keep: str = "largest", most_broadcast_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names; of rows that repeat a doc_id and an equal text one stays."""
    judged = written(exact_dedup(docs, keep).filter("group_size > 1").select(F.col("doc_id").alias("id"), "digest", "kept"), "digest-judged")
    gone = judged.filter("not kept").select("id", "digest").distinct()
    norm = normalised(F.col("text"))
    # the columns travel in a struct, so that none of them meets a name used here
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), sha256_digest(norm).alias("digest"))
    same = lambda t: rows["id"].eqNullSafe(t["id"]) & (rows["digest"] == t["digest"])
    twice = written(judged.filter("kept").groupBy("id", "digest").count().filter("count > 1").select("id", "digest"), "digest-twice")
    whole = lambda df: df.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
    if twice.isEmpty():
        return whole(rows.join(broadcast_if_below(gone, 96, most_broadcast_bytes), same(gone), "left_anti"))
    once = rows.join(gone.union(twice), same(gone), "left_anti")
    again = rows.join(twice, same(twice), "left_semi").withColumn("norm", normalised(F.col("row").getField("text")))
    return whole(once).unionByName(whole(again.dropDuplicates(["id", "norm"])))
