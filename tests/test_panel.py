"""Unit cases with known values, no-op properties, and a choice of queries against DuckDB."""

import datetime as dt
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quartz_panel.functions import scalar as S
from quartz_panel.operators import crosssection as X
from quartz_panel.operators import evaluate as E
from quartz_panel.operators import fundamentals as U
from quartz_panel.operators import models as M
from quartz_panel.operators import price as P
from quartz_panel.operators.asof import asof_join
from quartz_panel.sources import ingest as G

D = dt.date


def test_asof_inclusive_null_safe_and_tolerant(spark):
    left = spark.createDataFrame([(1, D(2020, 1, 5)), (1, D(2020, 1, 1)), (2, D(2020, 1, 5))], "k long, d date")
    right = spark.createDataFrame([(1, D(2020, 1, 2), 1, None), (1, D(2020, 1, 5), 2, 7.0), (1, D(2020, 1, 5), 3, None), (1, D(2020, 2, 1), 4, 9.0)], "k long, t date, n long, v double")
    got = {(r.k, r.d): (r.n, r.v) for r in asof_join(left, right, ["k"], "d", "t", ["n", "v"], tie=["n"]).collect()}
    assert got == {(1, D(2020, 1, 5)): (3, None), (1, D(2020, 1, 1)): (None, None), (2, D(2020, 1, 5)): (None, None)}
    got = {(r.k, r.d): (r.n, r.v) for r in asof_join(left, right, ["k"], "d", "t", ["n", "v"], tie=["n"], per_column=True).collect()}
    assert got[1, D(2020, 1, 5)] == (3, 7.0)
    ahead = {(r.k, r.d): r.n for r in asof_join(left, right, ["k"], "d", "t", ["n"], tie=["n"], forward=True).collect()}
    assert ahead[1, D(2020, 1, 1)] == 1 and ahead[2, D(2020, 1, 5)] is None
    near = asof_join(left, right.filter("n = 1"), ["k"], "d", "t", ["n"], tolerance_days=2).filter("n is not null").count()
    assert near == 0


@pytest.mark.parametrize("ts,day", [("2024-01-10 20:59:00", D(2024, 1, 10)), ("2024-01-10 21:00:00", D(2024, 1, 11)), ("2024-07-10 19:59:59", D(2024, 7, 10)), ("2024-07-10 20:00:00", D(2024, 7, 11)), ("2023-12-31 22:00:00", D(2024, 1, 1))])
def test_close_bucket(spark, ts, day):
    assert spark.range(1).select(S.close_bucket(F.lit(ts).cast("timestamp")).alias("d")).first().d == day


def test_scalars(spark):
    r = spark.range(1).select(
        S.log_ratio(F.lit(0.0), F.lit(1.0)).alias("a"), S.safe_ratio(F.lit(1.0), F.lit(1e-10)).alias("b"), S.months_before(F.lit("2021-03-31").cast("date"), 1).alias("c"), S.zscore_array(F.array(F.lit(1.0), F.lit(3.0))).alias("z"), S.zscore_array(F.array(F.lit(2.0), F.lit(2.0))).alias("y")
    ).first()
    assert (r.a, r.b, r.c, r.z, r.y) == (0.0, 0.0, D(2021, 2, 28), [-1.0, 1.0], [0.0, 0.0])


def test_estimate_golden_values(spark):
    rows = [(1, D(2020, 1, 15), 3.0, None, 4.0, None, None, None, 10.0, None), (1, D(2020, 3, 20), 2.0, None, 5.0, 0.1, 20.0, 10.0, 12.0, 8.0)]
    e = spark.createDataFrame(rows, "ticker_id long, as_of_date date, rec_mean double, price_target_mean double, eps_mean double, eps_std double, fwd_pe double, fwd_ev_ebitda double, num_analysts double, pt_num_estimates double")
    s = spark.createDataFrame([(1, D(2020, 4, 1), 0.8, 1.0, 100.0, 110.0)], "ticker_id long, report_date date, eps_consensus double, eps_actual double, rev_consensus double, rev_actual double")
    r = U.estimate_features(spark.createDataFrame([(1, D(2020, 4, 30))], "ticker_id long, date date"), e, s).first()
    assert (r.rec_mean_level, r.rec_rev_30d, r.rec_rev_90d, r.forward_earnings_yield, r.forward_ebitda_yield) == (2.0, 0.0, 1.0, 0.05, 0.1)
    assert (round(r.revenue_surprise, 9), round(r.eps_surprise, 9), r.eps_est_rev_90d, r.coverage_chg_90d, r.pt_num_estimates) == (0.1, 0.25, 0.25, 2.0, 8.0)


def test_ttm_with_nulls_and_many_amendments(spark):
    """A null quarter takes no place among the four; amendments, however many, hide no older period."""
    q = [(D(2020, 3, 31), 1.0), (D(2020, 6, 30), None), (D(2020, 9, 30), 1.0), (D(2021, 3, 31), 1.0), (D(2021, 6, 30), 1.0)]
    rows = [(1, f"a{i}", "10-Q", p, p + dt.timedelta(40), v, v, v) for i, (p, v) in enumerate(q)]
    rows += [(2, "y0", "10-K", D(2020, 12, 31), D(2021, 2, 1), 5.0, None, 5.0), (2, "y1", "10-K", D(2021, 12, 31), D(2022, 2, 1), None, None, 6.0)]
    rows += [(3, f"b{i:02}", "10-Q", p, p + dt.timedelta(40), 1.0, 1.0, 1.0) for i, p in enumerate([D(2021, 3, 31), D(2021, 6, 30), D(2021, 9, 30)])]
    rows += [(3, f"c{i:02}", "10-Q", D(2021, 12, 31), D(2022, 2, 1) + dt.timedelta(i), 1.0, 1.0, float(i)) for i in range(15)]
    f = spark.createDataFrame(rows, "ticker_id long, accession_number string, filing_type string, period_end date, filed_at date, revenue double, net_income double, fcf double")
    got = {r.accession_number: (r.ttm_revenue, r.ttm_net_income, r.ttm_fcf) for r in U.ttm(f).collect()}
    assert got["a3"] == (0.0,) * 3 and got["a4"] == (0.0,) * 3  # three quarters, and then four over 456 days
    assert got["y0"] == (5.0, 0.0, 5.0) and got["y1"] == (5.0, 0.0, 6.0)
    assert got["c14"] == (4.0, 4.0, 17.0)


def test_a_nan_price_is_a_gap(spark):
    import math

    day = D(2020, 1, 1)
    price = lambda i, t: math.nan if (i, t) == (300, 1) else 100.0 * math.exp(0.001 * i + 0.02 * math.sin(i * (1 + t)))
    bars = spark.createDataFrame([(t, day + dt.timedelta(i), price(i, t), 1000) for t in (1, 2, 3) for i in range(700)], "ticker_id long, trade_date date, adj_close double, volume long")
    names = spark.createDataFrame([(t, 1e6, "s", "i") for t in (1, 2, 3)], "ticker_id long, shares_outstanding double, sector string, industry string")
    rows = P.price_factors(bars, names).filter("ticker_id = 1").orderBy("pos").collect()
    assert not any(isinstance(v, float) and math.isnan(v) for r in rows if r.pos > 300 for v in r)
    assert rows[-1].vol_60d > 0 and rows[-1].beta_252d != 0 and rows[350 - 252].ma_gap_50 is not None


def test_smoothing_is_linear_and_skips_nulls(spark):
    r = spark.createDataFrame([(1, D(2020, 1, 1), 1.0), (1, D(2020, 2, 1), None), (1, D(2020, 3, 1), 0.0), (2, D(2020, 1, 1), 0.5)], "ticker_id long, date date, rank double")
    got = {(x.ticker_id, x.date.month): x.smooth for x in E.ewma_rank(r, 3).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 1.0, (1, 3): 0.5, (2, 1): 0.5}
    assert E.ewma_rank(r.limit(0), 3).count() == 0


def test_drift_and_upsert(spark):
    old = spark.createDataFrame([(1, D(2020, 1, 1), 100.0), (2, D(2020, 1, 1), 0.0), (3, D(2020, 1, 1), 100.0)], "ticker_id long, trade_date date, adj_close double")
    new = spark.createDataFrame([(1, D(2020, 1, 1), 101.0), (2, D(2020, 1, 1), 5.0), (3, D(2020, 1, 1), 100.05)], old.schema)
    assert {r.ticker_id: r.drifted for r in G.detect_drift(old, new).collect()} == {1: True, 2: False, 3: False}
    once = G.upsert(old, new, ["ticker_id", "trade_date"])
    assert once.count() == 3 and G.upsert(once, new, ["ticker_id", "trade_date"]).exceptAll(once).count() == 0


def panel(spark, signal=0.0):
    rows = [(D(2000 + k // 12, k % 12 + 1, 1), i, float((i * 37 + k * 11) % 60), i) for k in range(24) for i in range(60)]
    df = spark.createDataFrame(rows, "date date, ticker_id long, x double, i long")
    noise = (F.pmod(F.xxhash64("date", "ticker_id"), F.lit(1000)) / 1000.0 - 0.5) * 60
    return df.withColumn("r", signal * F.col("x") + noise).withColumn("knife_score", F.pmod(F.col("i") * 7, F.lit(60)) / 60.0)


def test_planted_signal_and_null(spark):
    p = panel(spark, 1.0)
    real, null = (E.ic_summary(E.rank_ic(q.withColumn("pred", F.col("x")), 30)).first() for q in (p, M.shuffled_labels(p, "r", 3)))
    assert real["mean"] > 0.2 and abs(null["mean"]) < 0.1 and real.n == null.n == 24
    boot = E.block_bootstrap(E.rank_ic(p.withColumn("pred", F.col("x")), 30), 3, reps=200).first()
    assert boot.ci_low < boot["mean"] < boot.ci_high and boot.p < 0.05


def test_no_ops(spark):
    p = X.rank01(panel(spark), ["date"], "x", "rank")
    assert X.knife_overlay(p, ["date"], "rank", "knife_score", 0.0, "o").filter("o <> rank").isEmpty()
    assert E.ewma_rank(p, 1).filter("abs(smooth - rank) > 1e-12").isEmpty()
    assert X.blend_ranks(p, ["date"], "x", "r", 0.0, "o").filter("o <> x").isEmpty()
    one = spark.createDataFrame([(D(2020, 1, 1), 1, 5.0)], "date date, ticker_id long, x double")
    assert X.rank01(one, ["date"], "x", "k").first().k == 0.5 and X.rank_normalize(one, ["x"]).first().x == 0.0


def test_embargo(spark):
    folds = E.walk_forward_folds(panel(spark).select("date"), 63, 12).collect()
    assert folds and all((f.test_date.year - f.cutoff.year) * 12 + f.test_date.month - f.cutoff.month == 3 for f in folds)


def test_model_round_trip(spark, tmp_path):
    p = panel(spark, 1.0)
    m = M.fit_ridge(p, ["x"], "r")
    M.save_model(spark, m, {"target": "r"}, str(tmp_path / "m"))
    again, spec = M.load_model(spark, str(tmp_path / "m"))
    assert spec == {"target": "r"} and list(again.coefficients) == list(m.coefficients)


def test_model_digest_is_of_the_content(spark, tmp_path):
    p = panel(spark, 1.0)
    m, n = M.fit_ridge(p, ["x"], "r"), M.fit_ridge(p, ["x"], "r", 1000.0)
    a, b, c, d = (M.save_model(spark, model, {"target": t}, str(tmp_path / k)) for k, model, t in (("a", m, "r"), ("b", m, "r"), ("c", n, "r"), ("d", m, "s")))
    assert a == b and len({a, c, d}) == 3
    assert M.save_model(spark, M.load_model(spark, str(tmp_path / "a"))[0], {"target": "r"}, str(tmp_path / "e")) == a
    trees = M.fit_trees(p, ["x"], "r", rounds=2)[0]
    assert M.save_model(spark, trees, {}, str(tmp_path / "t")) == M.save_model(spark, trees, {}, str(tmp_path / "u")) != a
    spark.createDataFrame([('{"target": "changed"}',)], "spec string").coalesce(1).write.mode("overwrite").json(str(tmp_path / "b" / "spec"))
    with pytest.raises(ValueError, match="saved"):
        M.load_model(spark, str(tmp_path / "b"))


@pytest.mark.parametrize("name", ["w01_bar_index", "a01_month_end_grid", "j08_forward_asof", "w18_ttm", "s04_upsert", "s08_filings_from_facts", "s13_table_rows", "w21_rolling_sentiment", "w27_forward_targets", "q06_job_status", "a12_bar_coverage", "t02_bar_upsert_stream", "e00_top_momentum", "x05_industry_relative", "x01_full_panel", "m13_horizon_models", "m14_horizon_scores"])
def test_query_against_duckdb(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(d):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{d}/{f}'")
    want, got = con.sql(entry.oracle_sql()[name]), entry.queries()[name](spark, d)
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    norm = lambda rows: sorted(tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows)
    assert norm(map(tuple, got.select(*columns).collect())) == norm((tuple(float(v) if v.__class__.__name__ == "Decimal" else v for v in r) for r in want.select(*(f'"{c}"' for c in columns)).fetchall()))


def test_entry_works_and_every_oracle_has_a_query(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
