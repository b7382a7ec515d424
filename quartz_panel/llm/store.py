"""Places that the driver and all executors share, and size checks before a broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; on ``local[...]`` alone an own one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a shared table and read it again: lineage is cut, lost executors cost nothing."""
    path = new_table_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(where, True)


class Scratch:
    """Written tables of one computation.  Those no longer read are deleted at once by ``drop``, so disk follows what is in use."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def written(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = new_table_path(self.spark, name)
        df.write.option("compression", codec).parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables whose readers have all been written."""
        for table in tables:
            delete(self.spark, self.paths.pop(id(table))[1])


def broadcast_if_below(df: DataFrame, row_bytes: int, most_bytes: int) -> DataFrame:
    """Hint a broadcast when the counted rows fit; otherwise leave the choice of join to Spark.

    ``df`` should be cheap to count (a written table)."""
    return F.broadcast(df) if df.count() * row_bytes <= most_bytes else df
