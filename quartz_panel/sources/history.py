"""History kept in buckets of a key: written once, then read by joins and windows on that key without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ingest import cache_key


def _done(spark: SparkSession, path: str) -> bool:
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.sc().hadoopConfiguration()).exists(marker)


def bucketed_history(spark: SparkSession, folder: str, name: str, symbols: list[str], build: Callable[[], DataFrame], key: str, order: str, buckets: int, refresh: bool = False) -> DataFrame:
    """``build()`` as a table of ``buckets`` buckets by ``key``, sorted by (key, order), under the symbol set's key in ``folder``.

    It is built where it isn't there, where the last writing didn't end, or on ``refresh``; else it is only read, and registered
    anew in a session that doesn't know it.  Each bucket is one file, written by one task.  All tables that are to meet without
    a shuffle need the same key and number of buckets: choose it by the largest, so that a bucket fits a task."""
    table = f"{name}_{cache_key(symbols)[:16]}_{buckets}"
    path = f"{folder.rstrip('/')}/{table}"
    known = spark.catalog.tableExists(table) and spark.sql(f"DESCRIBE FORMATTED {table}").filter(f"col_name = 'Location' and data_type like '%{path.lstrip('/')}'").count() > 0
    if refresh or not _done(spark, path):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        build().repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key, order).option("path", path).saveAsTable(table)
    elif not known:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`, `{order}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)
