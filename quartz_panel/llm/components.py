"""Connected components of a link table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def connected_components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node, component (the smallest node that links reach) for every node of ``links`` (a, b).

    In a round each node hears the least label of its neighbours; the node and the node that its label
    names both take it, and then the label's own label, so whole trees join at once and long chains
    halve.  Rounds go on until no label changes.  Each is a written table, the one before is deleted;
    hot nodes are pre-aggregated before the shuffle."""
    keep = scratch or Scratch(links.sparkSession)
    both = keep.written(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "links")
    labels = keep.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component"), F.lit(True).alias("moved")), "labels")
    while not labels.filter("moved").isEmpty():
        now = labels.select("node", "component")
        heard = both.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        told = heard.join(now, "node").select(F.explode(F.array("node", "component")).alias("node"), "heard").groupBy("node").agg(F.min("heard").alias("heard"))
        least = now.join(told, "node").select("node", F.col("component").alias("old"), F.least("component", "heard").alias("near"))
        jump = now.select(F.col("node").alias("near"), F.col("component").alias("far"))
        new = least.join(jump, "near").select("node", F.least("near", "far").alias("component"), (F.least("near", "far") < F.col("old")).alias("moved"))
        new = keep.written(new, "labels")
        keep.drop(labels)
        labels = new
    keep.drop(both)
    return labels


def with_links(parts: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component after further ``links`` (a, b): a written table.  Rounds run over the components that the links touch alone."""
    parts = parts.select("node", "component")
    part = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"{end}_part"))
    ends = links.join(part("a"), "a", "left").join(part("b"), "b", "left").select(*(F.coalesce(f"{end}_part", end).alias(end) for end in "ab"))
    roots = connected_components(ends, scratch)
    new = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(parts, "node", "left_anti").select("node", F.col("node").alias("component"))
    root = roots.select(F.col("node").alias("component"), F.col("component").alias("root"))
    out = parts.union(new).join(root, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    out = scratch.written(out, "labels")
    scratch.drop(roots)
    return out
