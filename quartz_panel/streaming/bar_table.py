"""A table of bars that a stream keeps up to date: batches touch only their own partitions, re-adjusted histories replace stored ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartz_panel.operators.cut import cut
from quartz_panel.sources.ingest import detect_drift


class BarTable:
    """Bars at ``path`` in ``buckets`` partitions by the hash of ticker_id; ``write`` is a foreachBatch function.

    A batch reads and rewrites the partitions of its names alone.  A name whose earliest overlapping price moved by more than ``limit``
    has drifted (a split or a dividend re-adjusted its past): its stored rows go, and ``history(names)``, its full history from the
    vendor (by default what the batch has), takes their place.  All other rows are inserted or put in place of rows of the same day.
    What a batch did to each name is kept beside the table.  A batch that is run again gives the same table and the same flags.

    A partition is written in files of about ``file_rows`` rows, a task for each, so tasks grow in number with the table, not in size."""

    def __init__(self, path: str, schema: T.StructType, buckets: int = 64, limit: float = 1e-3, history: Callable[[DataFrame], DataFrame] | None = None, file_rows: int = 500_000):
        self.path, self.schema, self.buckets, self.limit, self.history, self.file_rows = path, schema, buckets, limit, history, file_rows

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("ticker_id"), F.lit(self.buckets)).cast("int"))

    def _exists(self, spark: SparkSession, path: str) -> bool:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(spark._jsc.sc().hadoopConfiguration()).exists(where)

    def stored(self, spark: SparkSession) -> DataFrame:
        kind = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        return spark.read.schema(kind).parquet(f"{self.path}/bars") if self._exists(spark, f"{self.path}/bars") else spark.createDataFrame([], kind)

    def write(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = cut(self._bucketed(batch.select(*self.schema.names)))
        touched = new.groupBy("bucket").agg(F.count("*").alias("n"), F.min("trade_date").alias("lo"), F.max("trade_date").alias("hi")).collect()  # at most ``buckets``
        if not touched:
            return
        stored = self.stored(spark).filter(F.col("bucket").isin([r.bucket for r in touched]))
        flags = self._flags(stored, new, touched, f"{self.path}/flags/batch={number}")
        names = flags.filter("drifted").select("ticker_id")
        layers = [stored.join(names, "ticker_id", "left_anti")]
        if self.history is not None:
            layers.append(self._bucketed(self.history(names).select(*self.schema.names)).join(names, "ticker_id", "left_semi"))
        files = -(-(stored.count() + sum(r.n for r in touched)) // (len(touched) * self.file_rows))
        self._put([*layers, new], len(touched), files)

    def _flags(self, stored: DataFrame, new: DataFrame, touched: list, path: str) -> DataFrame:
        """ticker_id, drifted of the batch's names, from the days alone that both sides may share; of a batch that is run again, those it had: by now the table has the new prices."""
        spark, kind = new.sparkSession, "ticker_id long, drifted boolean"
        if not self._exists(spark, f"{path}/_SUCCESS"):
            span = [r for r in touched if r.lo is not None]
            both = F.col("trade_date").between(F.lit(min((r.lo for r in span), default=None)), F.lit(max((r.hi for r in span), default=None)))
            last = stored.filter(both).agg(F.max("trade_date")).first()[0]
            drift = detect_drift(stored.filter(both), new.filter(F.col("trade_date") <= F.lit(last)), self.limit)
            new.select("ticker_id").distinct().join(drift, "ticker_id", "left").select("ticker_id", F.coalesce("drifted", F.lit(False)).alias("drifted")).write.mode("overwrite").parquet(path)
        return spark.read.schema(kind).parquet(path)

    def _put(self, layers: list[DataFrame], touched: int, files: int) -> None:
        """Puts the rows of ``layers`` in place of their partitions, later layers before earlier ones of a name's day.

        One shuffle deals a partition's names to ``files`` tasks; the sort that finds the latest row of a day is the one by which files are written.
        What is overwritten can be read meanwhile: old files go when all new ones have been written."""
        columns = [*self.schema.names, "bucket"]
        rows = None
        for k, layer in enumerate(layers):
            layer = layer.select(*columns, F.lit(k).alias("__layer"))
            rows = layer if rows is None else rows.unionByName(layer)
        rows = rows.withColumn("__part", F.pmod(F.xxhash64(F.lit("part"), "ticker_id"), F.lit(files)))
        latest = Window.partitionBy("bucket", "__part", "ticker_id", "trade_date").orderBy(F.desc("__layer"))
        rows = rows.repartition(2 * touched * files, "bucket", "__part").withColumn("__rn", F.row_number().over(latest)).filter("__rn = 1").select(*columns)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/bars")

    def read(self, spark: SparkSession) -> DataFrame:
        return self.stored(spark).drop("bucket")

    def drifted(self, spark: SparkSession) -> DataFrame:
        """ticker_id, drifted: whether any batch has re-adjusted the name."""
        return spark.read.schema("ticker_id long, drifted boolean, batch int").parquet(f"{self.path}/flags").groupBy("ticker_id").agg(F.max("drifted").alias("drifted"))
