"""What keeps the panel linear in disk and time: no bars joined to bars, no melted ranks, roundings that tie as in SQL."""

import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from quartz_panel.operators import crosssection as X
from quartz_panel.operators import fundamentals as U
from quartz_panel.operators import price as P
from quartz_panel.operators import sentiment as T
from quartz_panel.operators.month_rows import PRICE, month_rows
from quartz_panel.plans import factor_queries as Q
from quartz_panel.plans import panel as L
from quartz_panel.sources import views as V

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rounding_ties_as_in_sql(spark):
    values = [v / 60 / (1e6 + 1000.0 * k) for k in range(0, 60000, 100) for v in range(600, 2400, 3)]
    con = duckdb.connect()
    want = [r[0] for r in con.sql("SELECT round(v / 60 / (1000000 + 1000 * k)::DOUBLE, 6) FROM (SELECT unnest(range(0, 60000, 100)) AS k), LATERAL (SELECT unnest(range(600, 2400, 3))::DOUBLE AS v) ORDER BY k, v").fetchall()]
    got = Q.rounded(spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i long, x double")).orderBy("i").collect()
    assert [r.x for r in got] == want


def test_price_panel_joins_no_bars(spark):
    bars, names = V.bars(spark, SF), V.tickers(spark, SF)
    factors = P.price_factors(bars, names).drop("adj_close", "pos").withColumnRenamed("trade_date", "bar_date")
    joined = L.grid_bars(bars).join(factors, ["ticker_id", "bar_date"])
    made = L.price_panel(spark, SF)
    assert made.columns == joined.columns and made.count() == joined.count() > 0
    key = lambda df: sorted(Q.rounded(df, digits=9).collect(), key=lambda r: (r.ticker_id, r.date))
    assert key(made) == key(joined.select(*made.columns))
    assert "SortMergeJoin" not in plan(made)


def test_ranks_are_made_in_one_shuffle(spark):
    rows = [(dt.date(2020, 1, 31), i, "s" if i % 2 else None, v, w) for i, (v, w) in enumerate([(1.0, None), (2.0, math.nan), (2.0, 0.0), (None, -0.0), (5.0, math.nan), (-1.0, 3.0)])]
    p = spark.createDataFrame(rows, "date date, ticker_id long, sector string, v double, w double")
    out = X.rank_normalize(p, ["v", "w"])
    assert plan(out).count("Exchange hashpartitioning") == 1
    got = {r.ticker_id: r for r in out.collect()}
    assert [got[i].v for i in range(6)] == [-0.5, 0.25, 0.25, None, 1.0, -1.0] and [got[i].w for i in range(6)] == [None, 0.75, -0.75, -0.75, 0.75, 0.0]
    by_sector = {r.ticker_id: r for r in X.rank_normalize(p, ["v", "w"], ("sector",), 2).collect()}
    assert [by_sector[i].v for i in range(6)] == [-0.5, 1.0, 0.25, None, 1.0, -1.0]


def test_medians_join_no_bars(spark):
    bars = V.bars(spark, SF)
    grid = P.month_end_grid(bars)
    some, every = P.forward_medians(bars, grid), P.forward_medians(bars)
    assert "SortMergeJoin" not in plan(every) and "BroadcastHashJoin [ticker_id" not in plan(every)
    kept = every.join(F.broadcast(grid.withColumnRenamed("date", "trade_date")), "trade_date", "left_semi")
    assert sorted(some.collect()) == sorted(kept.collect()) and some.count() > 0


def test_rolling_extremes(spark):
    b = spark.createDataFrame([(1, dt.date(2020, 1, 1) + dt.timedelta(days=i), float((i * 37) % 101) if i % 5 else None) for i in range(300)], "ticker_id long, trade_date date, x double")
    for n in (1, 2, 5, 21, 40, 252):
        out = P.rolling_extremes(b, {"hi": (F.col("x"), n, True), "lo": (F.col("x"), n, False)})
        out = out.withColumns({"h": F.max("x").over(P.rows(n)), "l": F.min("x").over(P.rows(n))})
        assert out.filter("not (hi <=> h) or not (lo <=> l)").count() == 0, n


def test_cut_stores_a_table_that_spent_deletes(spark):
    import pytest

    from quartz_panel.operators.cut import cut, spent

    t = cut(spark.range(5).withColumn("x", F.col("id") * 2))
    assert "Scan parquet" in plan(t.select("x")) and t.count() == 5
    path = t.inputFiles()[0]
    spent(t)
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_full_panel_sends_no_side_to_the_driver(spark):
    """Sides meet the bars by name: no join but that of the dates and the calendar's medians, whatever a side's file is compressed to."""
    bars, grid = V.bars(spark, SF), [r.date for r in P.month_end_grid(V.days(spark, SF)).collect()]
    sides = {"filings": U.annotated(V.filings(spark, SF)), "estimates": V.estimates(spark, SF), "surprises": V.surprises(spark, SF), "short_interest": V.short_interest(spark, SF), "sentiment": T.rolling_sentiment(T.sentiment_daily(V.headlines(spark, SF)))}
    made = month_rows(bars, V.tickers(spark, SF), P.universe_returns(bars), grid, sides)
    whole = L.full_panel(spark, SF)
    assert "FlatMapCoGroupsInArrow" in plan(made) and plan(whole).count("Join") == 1 and "BroadcastHashJoin [date" in plan(whole)
    keys = L.price_panel(spark, SF).select("ticker_id", "date", "pos").cache()
    at = ["ticker_id", "date"]
    for want in (
        U.filing_reaction(keys, V.filings(spark, SF), bars, P.universe_returns(bars)),
        U.estimate_features(keys, sides["estimates"], sides["surprises"]),
        U.short_ratio(keys, sides["short_interest"]),
        T.filled(keys.select(*at), sides["sentiment"]),
    ):
        cols = [c for c in want.columns if c not in at]
        rows = [Q.rounded(x.select(*at, *cols), digits=9).orderBy(*at).collect() for x in (want, made)]
        assert rows[0] == rows[1] and rows[0]


def test_month_rows_of_odd_names(spark):
    """A name without a row of its own, one without bars, missing prices and days, a block that holds one name."""
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i)
    rows = [(t, day(i), None if i % 9 == 4 else 10.0 + (i * t) % 7, 5.0) for t in (1, 2, 700) for i in range(80)] + [(1, None, 3.0, 1.0)]
    bars = spark.createDataFrame(rows, "ticker_id long, trade_date date, adj_close double, volume double")
    names = spark.createDataFrame([(1, "s", "i", 1e6), (3, "s", None, 1e6), (700, None, "i", 1e6)], "ticker_id long, sector string, industry string, shares_outstanding double")
    shorts = spark.createDataFrame([(1, day(50), day(40), None, 6.0, 3.0), (2, day(50), day(40), 9.0, None, None), (1, None, day(41), 8.0, None, None)], "ticker_id long, publication_date date, settlement_date date, days_to_cover double, short_interest double, avg_daily_volume double")
    grid = [day(30), day(59), day(79 + 7), day(79 + 8), None]
    got = {(r.ticker_id, r.date): r for r in month_rows(bars, names, P.universe_returns(bars), grid, {"short_interest": shorts}, min_pos=40).collect()}
    assert sorted(got) == [(t, d) for t in (1, 700) for d in (day(59), day(86))]
    assert [got[1, d].short_ratio for d in (day(59), day(86))] == [2.0, 2.0] and got[700, day(59)].short_ratio == 0.0
    assert got[1, day(86)].bar_date == day(79) and got[1, day(86)].pos == 79 and (got[700, day(59)].sector, got[1, day(59)].sector) == (None, "s")
    want = {r.ticker_id: r for r in P.price_factors(bars.filter("trade_date is not null"), names, min_pos=40).filter(F.col("trade_date") == F.lit(day(59))).collect()}
    for t in (1, 700):
        assert all(getattr(got[t, day(59)], c) == pytest.approx(getattr(want[t], c), abs=1e-9) for c in PRICE)


def test_prepared_rows_are_made_in_one_shuffle_by_date(spark, monkeypatch):
    """Demeaned returns, knife score and labels of ``prepared`` are those of the operators that shuffle for each of them."""
    p = L.price_panel(spark, SF)
    for c in (c for c in L.all_features() if c not in p.columns):
        p = p.withColumn(c, F.lit(0.0))
    p = p.withColumn("ma_gap_200", F.when(F.col("ticker_id") % 4 > 0, F.col("ma_gap_200")))
    p = L.cut(p)
    medians = P.forward_medians(V.bars(spark, SF), P.month_end_grid(V.days(spark, SF))).filter("horizon <> '1M' or month(trade_date) <> 5")
    targets, plans, cut = {h: s["target"] for h, s in L.HORIZON_SPECS.items()}, [], L.cut
    monkeypatch.setattr(L, "cut", lambda df: plans.append(plan(df)) or cut(df))
    made = L.prepared(p, medians, targets=targets)
    assert plans[-1].count("Exchange hashpartitioning") == 1
    want = p.withColumn("vol_120d_raw", F.col("vol_120d"))
    for h in targets:
        want = X.demean(want, medians.filter(F.col("horizon") == h).withColumnRenamed("trade_date", "date"), h)
    want = X.knife_score(X.rank_normalize(want, L.all_features()), ranked=True)
    for h, mode in targets.items():
        want = L.targeted(want, h, mode, f"label_{h}")
    cols = ["date", "ticker_id", *sorted(set(want.columns) - {"date", "ticker_id"})]
    assert sorted(made.columns) == sorted(cols) and "label_3M" in cols
    rows = [Q.rounded(x.select(*cols), digits=9).orderBy("date", "ticker_id").collect() for x in (want, made)]
    assert rows[0] == rows[1] and len(rows[0]) > 300


def test_grid_medians_read_the_dates_they_need(spark):
    bars = V.bars(spark, SF)
    want = P.forward_medians(bars, P.month_end_grid(bars))
    got = P.grid_medians(bars, [r.trade_date for r in V.days(spark, SF).collect()])
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 100


def test_labels_that_are_stored_are_not_made_again(spark):
    """The horizons of the walk-forward and production queries take the labels of ``prepared``; no window, no shuffle for each."""
    p = spark.range(3).select(F.col("id").alias("ticker_id"), F.lit(dt.date(2020, 1, 31)).alias("date"), F.lit("s").alias("sector"), F.lit(0.5).alias("r_3M"), F.lit(True).alias("mask_3M"), F.lit(0.25).alias("label_3M"))
    made = L.targeted(p, "3M", "sector_return")
    assert "Window" not in plan(made) and "Exchange" not in plan(made) and [r.y for r in made.collect()] == [0.25] * 3
