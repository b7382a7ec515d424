"""The stream's bar table: drift replaces a name's history, batches touch their own partitions, a batch may run twice."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from quartz_panel import plans
from quartz_panel.operators.cut import cut
from quartz_panel.plans import stream_queries
from quartz_panel.streaming.bar_table import BarTable

SCHEMA = "ticker_id long, trade_date date, adj_close double, volume double"


def bars(spark, rows):
    return spark.createDataFrame([(t, dt.date(2020, 1, d), p, 1.0) for t, d, p in rows], SCHEMA)


def held(table, spark):
    return {(r.ticker_id, r.trade_date.day): r.adj_close for r in table.read(spark).collect()}


def files(path):
    return {f"{a}/{f}": os.stat(f"{a}/{f}").st_mtime_ns for a, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def table(spark, tmp_path):
    full = bars(spark, [(1, d, 50.0 + d) for d in range(1, 9)] + [(9, 1, 7.0)])
    asked = []
    made = BarTable(str(tmp_path / "t"), full.schema, 8, history=lambda names: asked.append(sorted(r.ticker_id for r in names.collect())) or full)
    made.asked = asked
    return made


def test_history_follows_a_drift_and_only_touched_partitions_are_written(spark, table):
    table.write(bars(spark, [(t, d, 100.0 + d) for t in (1, 2, 3, 4, 5) for d in range(1, 6)]), 0)
    before = files(f"{table.path}/bars")
    table.write(bars(spark, [(1, 5, 55.0), (1, 6, 56.0), (2, 5, 105.00001), (2, 6, 106.0), (2, 6, 106.0)]), 1)
    want = {(t, d): 100.0 + d for t in (2, 3, 4, 5) for d in range(1, 6)} | {(1, d): 50.0 + d for d in range(1, 9)} | {(2, 5): 105.00001, (2, 6): 106.0}
    assert held(table, spark) == want and table.asked[-1] == [1]
    assert {r.ticker_id: r.drifted for r in table.drifted(spark).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}
    after = files(f"{table.path}/bars")
    touched = {r.bucket for r in table.stored(spark).filter("ticker_id in (1, 2)").select("bucket").distinct().collect()}
    same = [f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched]
    assert same and all(after.get(f) == before[f] for f in same)
    assert not any(f in after for f in before if f not in same)


def test_a_batch_may_run_again(spark, table):
    table.write(bars(spark, [(1, 1, 200.0), (1, 2, 201.0)]), 0)
    batch = bars(spark, [(1, 2, 52.0), (1, 3, 53.0)])
    table.write(batch, 1)
    once, flags = held(table, spark), table.drifted(spark).collect()
    table.write(batch, 1)
    assert held(table, spark) == once == {(1, d): 50.0 + d for d in range(1, 9)} and table.drifted(spark).collect() == flags


def test_no_drift_without_a_stored_price(spark, table):
    table.write(bars(spark, [(1, 1, None), (2, 1, 0.0)]), 0)
    table.write(bars(spark, [(1, 1, 5.0), (2, 1, 9.0), (3, 1, 1.0)]), 1)
    table.write(bars(spark, []), 2)
    assert held(table, spark) == {(1, 1): 5.0, (2, 1): 9.0, (3, 1): 1.0} and not any(r.drifted for r in table.drifted(spark).collect())


def test_a_partition_is_written_by_several_tasks(spark, tmp_path):
    full = bars(spark, [(t, d, 50.0 + d) for t in range(20) for d in range(1, 9)])
    table = BarTable(str(tmp_path / "t"), full.schema, 2, history=lambda names: full, file_rows=10)
    table.write(bars(spark, [(t, d, 100.0 + d) for t in range(40) for d in range(1, 6)]), 0)
    table.write(bars(spark, [(t, d, (50.0 if t < 20 else 100.0) + d) for t in range(40) for d in (5, 6)] + [(0, 8, 1.5)]), 1)
    assert held(table, spark) == {(t, d): (50.0 if t < 20 else 100.0) + d for t in range(40) for d in range(1, 9 if t < 20 else 7)} | {(0, 8): 1.5}
    count = [f.split("/part-")[0] for f in files(f"{table.path}/bars")]
    assert all(count.count(folder) > 5 for folder in count) and len(set(count)) == 2
    homes = table.read(spark).select("ticker_id", F.input_file_name().alias("f")).distinct().groupBy("ticker_id").count()
    assert homes.filter("count > 1").isEmpty()  # a name's rows are in one file


def test_stream_parts_are_files_of_many_tasks_and_one_batch_each(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream_queries, "stream_folder", lambda spark, name: str(tmp_path))
    d = str(tmp_path / "data")
    lines = [(t, dt.datetime(1999, 6, 1) + dt.timedelta(days=3 * k), 1.0 + k % 4, 100.0 + k + t, 0.1, 0.0, "R", k) for t in range(12) for k in range(90)]
    kind = "l_suppkey long, l_shipdate timestamp, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_orderkey long"
    spark.createDataFrame(lines, kind).write.parquet(f"{d}/lineitem.parquet")
    monkeypatch.setattr(stream_queries, "cut", lambda df: cut(df.repartition(3, "ticker_id")))
    got = plans.queries()["t02_bar_drift_stream"](spark, d).collect()
    assert len(got) == len(lines) and all(r.drifted == (r.ticker_id % 3 == 0) for r in got)
    price = {(t, day.date()): p / q for t, day, q, p, *_ in lines}
    assert all(abs(r.adj_close - price[r.ticker_id, r.trade_date] * (1.01 if r.drifted else 1.0)) < 0.006 for r in got)
    assert len([f for f in os.listdir(tmp_path / "in") if f.endswith(".parquet")]) == 6
    assert sorted(f for f in os.listdir(tmp_path / "state" / "commits") if f.isdigit()) == ["0", "1"]
