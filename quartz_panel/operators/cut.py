"""Ends a long lineage at a shared table, so that a lost executor costs what follows alone and plans stay short."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

#: The folder of each table, by the table.
_FOLDERS: dict[int, tuple[DataFrame, str]] = {}


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the folder that spark.checkpoint.dir names; on ``local[...]`` alone an own one is set where it is unset.

    Readers take only the columns they need.  Shuffle files of what has been written are let go."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not found:
            if not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            found = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        sc.setCheckpointDir(found)
    if any(kind == "void" for _, kind in df.dtypes):  # has no place in a file
        return df.checkpoint()
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[id(table)] = (table, path)
    spark._jvm.System.gc()  # Spark's cleaner follows the driver's garbage
    return table


def spent(*tables: DataFrame) -> None:
    """Deletes tables of ``cut`` whose readers have all been written."""
    for table in tables:
        path = _FOLDERS.pop(id(table), (None, None))[1]
        if path:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(where, True)
