"""The headline stream against the batch SQL, and over several files."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quartz_panel.plans.service_queries import headline_stream

DIR = "/root/testdata/sf0.001"


def batch_sql(events):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{events}')")
    return {(r[0], r[1]): (float(r[2]), r[3]) for r in con.sql("SELECT ticker_id, score_date, mean_score, headline_count FROM (" + entry.oracle_sql()["a02_sentiment_daily"] + ")").fetchall()}


def streamed(df):
    return {(r.ticker_id, r.score_date): (float(r.mean_score), r.headline_count) for r in df.collect()}


def test_stream_equals_the_batch_sql_up_to_the_last_day(spark):
    assert streamed(entry.queries()["t01_headline_stream"](spark, DIR)) == batch_sql(f"{DIR}/events.parquet")


def test_files_out_of_order_and_repeated_urls(spark, tmp_path):
    events = spark.read.parquet(f"{DIR}/events.parquet")
    path = f"{tmp_path}/events.parquet"
    # files of about five days, each later one written before an earlier one; the last repeats the first's rows
    for k in (1, 0, 3, 2, 5, 4):
        events.filter(F.floor((F.dayofmonth("ts") - 1) / 5) == k).coalesce(1).write.mode("append").parquet(path)
    once = batch_sql(f"{path}/*.parquet")
    assert streamed(headline_stream(spark, str(tmp_path), max_files=1)) == once
    assert streamed(headline_stream(spark, str(tmp_path))) == once
    events.filter("dayofmonth(ts) > 25").coalesce(1).write.mode("append").parquet(path)
    assert streamed(headline_stream(spark, str(tmp_path), max_files=1)) == once
    assert streamed(headline_stream(spark, str(tmp_path))) == once
