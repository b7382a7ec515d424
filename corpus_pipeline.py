"""Training-text pipeline over ``documents``: quality rules, exact dedup, near-duplicate join, substring dedup, packing.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet and read
again as the next stage's docs, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartz_panel.llm.exact_dedup import deduplicated
from quartz_panel.llm.ngram_join import Setting, ngram_jaccard_join
from quartz_panel.llm.packing import packed
from quartz_panel.llm.quality import quality_rules
from quartz_panel.llm.store import Scratch, broadcast_if_below, written
from quartz_panel.llm.substring_dedup import substring_dedup


#: Near-duplicates of the pipeline: 5-word shingles, similarity 0.8 or more.
NEAR = Setting(shingle=5, percent=80)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their boilerplate lines.  Null and empty texts go; repeats are judged alike; any other columns are carried."""
    judged = quality_rules(docs).filter("quality.kept")
    new = {"text": F.col("quality.clean_text"), "n_chars": F.length("quality.clean_text").cast("long")}
    return judged.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null counts as empty) the row with the largest doc_id, of repeated rows one."""
    return deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id.  Texts without a word and rows without a doc_id stay."""
    gone = written(ngram_jaccard_join(docs, NEAR).filter("doc_id <> component_id").select("doc_id").distinct(), "near-gone")
    return docs.join(broadcast_if_below(gone, 32, 8 << 20), "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without word runs that stand earlier; documents of which nothing is left go.  Texts that lose nothing stay as they are."""
    left = substring_dedup(docs, as_is=True).filter("n_removed = 0 or n_removed < n_words")
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return left.select(*(new.get(c, F.col("carried").getField(c)).alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of texts in length buckets and token-budget batches."""
    return packed(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("substring dedup", substrings), ("packing", packing)]

#: The near-duplicate components and the optimal boundaries have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages before keep of ``documents``; an empty table gives none.  A stage's table goes once the next is written."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[DataFrame] = []
    for name, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
