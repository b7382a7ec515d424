"""Walk-forward ridge from cumulated Gram matrices against a fit per fold; permutation null; knife parts; the query's horizons."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quartz_panel.operators import crosssection as X
from quartz_panel.operators import evaluate as E
from quartz_panel.operators import gram as G
from quartz_panel.operators import models as M
from quartz_panel.plans import panel as L
from quartz_panel.plans import walk_queries as Q

from .test_panel import panel

FEATURES = ["x", "z", "u"]


@pytest.fixture(scope="module")
def rows(spark):
    noise = lambda k: F.pmod(F.xxhash64("date", "ticker_id", F.lit(k)), F.lit(1000)) / 1000.0
    p = panel(spark, 0.5).withColumns({"z": noise("z"), "u": noise("u"), "sector": F.concat(F.lit("s"), F.col("i") % 3)})
    p = p.withColumn("u", F.when(F.col("i") % 7 > 0, F.col("u"))).withColumn("y", F.when((F.col("i") % 11 > 0) & (F.month("date") != 5), F.col("r") / 60))
    return p.repartition(5, "ticker_id").cache()


def ridge(frame, alpha):
    x, y = frame[FEATURES].fillna(0.0).to_numpy(), frame["y"].to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(len(FEATURES)), xc.T @ yc)
    return y.mean() - x.mean(0) @ w, w


@pytest.mark.parametrize("window", [None, 6])
def test_each_fold_and_penalty_equals_its_own_fit(spark, rows, window):
    frame = rows.toPandas()
    folds = G.folds_of(rows, 63, 12, window)
    assert len(folds) == 24 - 15
    got = {(r.test_date, r.alpha): r for r in G.ridge_folds(rows, FEATURES, "y", folds, (0.5, 10.0, 1000.0)).collect()}
    assert len(got) == 3 * len(folds)
    for f in folds:
        train = frame[(frame.date <= f.cutoff) & (frame.date >= f.lower) & frame.y.notna()]
        assert window is None or train.date.nunique() <= window + 1
        for alpha in (0.5, 10.0, 1000.0):
            b0, w = ridge(train, alpha)
            r = got[f.test_date, alpha]
            assert r.n_train == len(train) and r.intercept == pytest.approx(b0, abs=1e-9) and np.allclose(r.coefficients, w, atol=1e-9)


def test_a_fold_equals_the_library_fit(spark, rows):
    f = G.folds_of(rows, 63, 12)[3]
    one = M.fit_ridge(rows.filter((F.col("date") <= f.cutoff)), FEATURES, "y")
    got = G.ridge_folds(rows, FEATURES, "y", [f]).first()
    assert np.allclose(got.coefficients, one.coefficients, atol=1e-7)


def test_permuted_labels_are_dealt_within_dates_and_fitted_by_fold(spark, rows):
    import hashlib

    frame = rows.toPandas()
    frame = frame[frame.y.notna()].sort_values(["date", "ticker_id"])
    folds, seeds = G.folds_of(rows, 63, 12)[:3], [3, 4]
    got = {(r.seed, r.test_date): r for r in G.permuted_folds(rows, FEATURES, "y", folds, seeds).collect()}
    for seed in seeds:
        dealt = frame.copy()
        for _d, part in frame.groupby("date"):
            order = sorted(part.ticker_id, key=lambda t: (hashlib.md5(f"{seed}:{part.date.iloc[0]}:{t}".encode()).hexdigest(), t))
            dealt.loc[part.index, "y"] = part.set_index("ticker_id").y.loc[order].to_numpy()
        assert (dealt.y != frame.y).mean() > 0.9 and np.isclose(dealt.y.sum(), frame.y.sum())
        for f in folds:
            b0, w = ridge(dealt[dealt.date <= f.cutoff], 10.0)
            assert got[seed, f.test_date].intercept == pytest.approx(b0, abs=1e-9) and np.allclose(got[seed, f.test_date].coefficients, w, atol=1e-9)


def test_planted_signal_is_beyond_the_null_and_noise_is_not(spark, rows):
    # a refit on permuted labels points anywhere among the features, so many of them that say nothing make the null narrow
    folds, features = G.folds_of(rows, 63, 12), ["x1", *(f"n{k}" for k in range(30))]
    noise = lambda k: F.pmod(F.xxhash64("ticker_id", "date", F.lit(k)), F.lit(997)) / 997.0
    p = rows.withColumns({"x1": F.col("x") / 60, "noise": noise("n"), **{f"n{k}": noise(k) for k in range(30)}})
    for label, beyond in (("y", True), ("noise", False)):
        r = p.withColumn("r", F.col(label))
        real = E.rank_ic(G.scored(r, features, G.ridge_folds(p, features, label, folds)), 30)
        null = E.rank_ic(G.scored(r, features, G.permuted_folds(p, features, label, folds, list(range(8)))), 30, ("seed", "date"))
        v = G.null_verdict(real, null).first()
        assert v.reps == 8 and (v.verdict == "beyond the null") == beyond


def test_ranks_without_overlay_smoothing_and_blend_are_the_model_ranks(spark, rows):
    folds = G.folds_of(rows, 63, 12)
    pred = G.scored(rows, FEATURES, G.ridge_folds(rows, FEATURES, "y", folds))
    plain = G.walk_forward_ranks(pred, "r", 30)
    assert plain.filter("rank <> raw_rank").isEmpty() and plain.select("date").distinct().count() == len(folds)
    changed = G.walk_forward_ranks(pred, "r", 30, 0.5, 4)
    one, two = (G.walk_forward_summary(x, (), 5, 30).first() for x in (plain, changed))
    assert one.turnover == one.turnover_raw == pytest.approx(two.turnover_raw) and two.turnover < one.turnover
    assert one.n == two.n == len(folds) and one["mean"] > 0.2
    assert G.blended(pred, pred, 0.0) is pred
    assert G.walk_forward_ranks(pred, "r", 61).isEmpty()


def test_knife_parts_that_are_missing(spark):
    rows = [("2020-01-31", i, v, t, w) for i, (v, t, w) in enumerate([(0.1, 0.5, 0.2), (0.4, None, 0.1), (None, -0.3, 0.3), (0.3, -0.5, 0.4), (0.9, -0.9, 0.05)])] + [("2020-02-29", 1, None, None, None)]
    p = spark.createDataFrame(rows, "date string, ticker_id int, vol_120d double, ma_gap_200 double, dist_low_252 double")
    f = p.toPandas()
    part = {c: f.groupby("date")[c].transform(lambda s: (s.rank() - 1) / max(s.count() - 1, 1) if s.count() > 1 else s * 0 + 0.5) for c in ("vol_120d", "ma_gap_200", "dist_low_252")}
    down = 1 - (part["ma_gap_200"] + part["dist_low_252"]) / 2
    knife = part["vol_120d"] * down
    want = knife.fillna(knife.groupby(f.date).transform("median")).fillna(0.5)
    for ranked, source in ((False, p), (True, X.rank_normalize(p, ["vol_120d", "ma_gap_200", "dist_low_252"]))):
        got = {(r.date, r.ticker_id): r for r in X.knife_score(source, ranked=ranked).collect()}
        for k in range(len(f)):
            r = got[f.date[k], f.ticker_id[k]]
            assert r.knife_score == pytest.approx(want[k]) and r.downtrend_p == pytest.approx(0.5 if np.isnan(down[k]) else down[k])
    tiers = {r.ticker_id: r.tier for r in X.knife_score(p).filter("date = '2020-01-31'").withColumn("tier", X.knife_tier()).collect()}
    assert tiers[4] == "high" and tiers[0] == "none" and tiers[1] == "none"
    assert X.knife_score(p.drop("vol_120d")).select("knife_score").distinct().collect() == [(0.5,)]


def test_every_horizon_follows_its_specification(spark, monkeypatch):
    features = L.feature_columns([p for p in L.PACKS if p != "knife"])
    noise = {c: F.pmod(F.xxhash64("date", "ticker_id", F.lit(c)), F.lit(1000)) / 1000.0 for c in features}
    p = panel(spark, 1.0).withColumns(noise).withColumn("mom_1m", F.col("x") / 60).withColumn("sector", F.concat(F.lit("s"), F.col("i") % 3)).drop("x")
    p = p.withColumns({k: v for h in ("1M", "3M", "6M", "1Y") for k, v in ((f"r_{h}", F.col("r")), (f"mask_{h}", F.col("i") % 5 > 0))}).drop("r")
    used, fit = [], G.ridge_folds
    monkeypatch.setattr(Q.L, "prepared_panel", lambda *a, **k: p)
    monkeypatch.setattr(Q.G, "ridge_folds", lambda t, f, y, folds: used.append((f, [(x.cutoff - x.lower).days for x in folds])) or fit(t, f, y, folds))
    got = {r.horizon: r for r in entry.queries()["m07_walk_forward_ic"](spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(L.HORIZON_SPECS)
    assert [f for f, _ in used] == [L.feature_columns(s["packs"], s.get("extra", ())) for s in L.HORIZON_SPECS.values()]
    for h, bars in (("1M", 1), ("3M", 3), ("6M", 6)):
        assert got[h].n == 24 - 12 - bars and got[h]["mean"] > 0.2
    assert got["3M"].turnover < got["3M"].turnover_raw and got["1M"].turnover == got["1M"].turnover_raw
