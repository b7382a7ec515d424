"""Small operators of matching and splitting: nulls, repeats and empty tables."""

import datetime as dt

from pyspark.sql import functions as F

from quartz_panel.operators import evaluate as E
from quartz_panel.operators import serve as R

DAY = dt.date


def test_symbols_in_any_case(spark):
    tickers = spark.createDataFrame([(1, "ABC"), (2, "d.E")], "ticker_id long, symbol string")
    asked = spark.createDataFrame([("abc", 5), ("D.e", 6), ("x", 7), (None, 8), ("ABC", 9)], "`a.s` string, n int")
    got = sorted((r.n, r.ticker_id, r.symbol) for r in R.by_symbol(asked, tickers, "a.s").collect())
    assert got == [(5, 1, "ABC"), (6, 2, "d.E"), (9, 1, "ABC")]
    same = asked.withColumnRenamed("a.s", "symbol")
    assert sorted(R.by_symbol(same, tickers, "symbol").select("symbol").toPandas().symbol) == ["ABC", "ABC", "d.E"]


def test_splicing(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0), (None, 4.0)], "k long, v double")
    fresh = spark.createDataFrame([(9.0, 1), (8.0, 3)], "v double, k long")
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, R.spliced(rows, fresh, ["k"]).collect()), key=key) == [(1, 9.0), (2, 3.0), (3, 8.0), (None, 4.0)]
    assert R.spliced(rows, fresh.limit(0), ["k"]).count() == 4


def test_active_names_that_no_user_added(spark):
    tickers = spark.createDataFrame([(1, True, False), (2, True, True), (3, False, False), (4, True, None), (1, True, False), (5, None, False)], "ticker_id long, active boolean, user_added boolean")
    rows = spark.range(1, 7).withColumnRenamed("id", "ticker_id")
    assert sorted(r.ticker_id for r in R.active_only(rows, tickers).collect()) == [1, 4]


def test_prior_ranks_and_their_stability(spark):
    rows = [(1, "6M", DAY(2020, m, 28), 1, m / 10) for m in range(1, 6)] + [(1, "6M", DAY(2020, 4, 28), 2, 0.9), (2, "6M", DAY(2020, 1, 28), 1, 0.5)]
    stored = spark.createDataFrame(rows, "ticker_id long, horizon string, as_of_date date, created_at int, rank double")
    p = E.prior_ranks(stored, "2020-05-28", 2)
    assert sorted((r.ticker_id, r.rn, r["rank"]) for r in p.collect()) == [(1, 1, 0.9), (1, 2, 0.3), (2, 1, 0.5)]
    assert {r.ticker_id: r.stability and round(r.stability, 9) for r in E.rank_stability(p).collect()} == {1: 0.3, 2: None}


def test_parts_and_mixes(spark):
    df = spark.createDataFrame([(DAY(2020, 6, 30), 1, 0.2), (DAY(2019, 1, 31), 1, 0.4), (DAY(2021, 12, 31), 2, 0.6)], "date date, ticker_id long, x double")
    end = F.lit("2022-01-31").cast("date")
    assert {r.date.year: r.p for r in df.select("date", E.time_part("date", end, 24, 6).alias("p")).collect()} == {2020: "val", 2019: "train", 2021: "holdout"}
    other = df.filter("ticker_id = 1 and x < 0.3").select("date", "ticker_id", F.lit(1.0).alias("y"))
    assert {r.x: round(r.m, 9) for r in E.matched_mix(df, other, "x", "y", 0.5, "m").collect()} == {0.2: 0.6, 0.4: 0.4, 0.6: 0.6}
    facts = E.window_facts(df.limit(0)).first()
    assert (facts.start, facts.n_rows, facts.names) == (None, 0, 0)


def test_strided_samples_need_a_label(spark):
    bars = spark.createDataFrame([(p, p > 8, None if p == 4 else p == 4) for p in range(12)], "pos long, mask_a boolean, mask_b boolean")
    assert [r.pos for r in E.strided_samples(bars, 1, 3, ["mask_a", "mask_b"]).collect()] == [10]
    assert E.strided_samples(bars, 1, 3, ["mask_a"]).count() == 1
