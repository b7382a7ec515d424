"""Production models against plain numpy, trees on a planted signal, ranks within groups by hand."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartz_panel.operators import crosssection as X
from quartz_panel.operators import models as M
from quartz_panel.operators import production as D

DAYS = [dt.date(2020, m, 28) for m in range(1, 13)]
SPECS = {
    "1M": {"features": ["a", "b"], "window": None, "knife_lambda": 0.0, "span": 0},
    "3M": {"features": ["b", "c"], "window": 4, "knife_lambda": 0.2, "span": 3},
}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for d in DAYS:
        for t in range(1, 21):
            a, b, c = rng.normal(size=3)
            y1 = None if t == 4 else float(a - 2 * b + rng.normal() / 10)
            y3 = None if d.month > 9 else (float("nan") if t == 5 else float(c + rng.normal() / 10))
            out.append((d, t, float(a), float(b), None if t == 6 else float(c), y1, y3))
    return out


@pytest.fixture(scope="module")
def panel(spark, rows):
    return spark.createDataFrame(rows, "date date, ticker_id long, a double, b double, c double, y_1M double, y_3M double")


def expected(rows, cols, label, window, excluded):
    kept = [r for r in rows if r[0] < DAYS[11] and r[1] not in excluded and r[label] is not None and not np.isnan(r[label])]
    if window:
        dates = sorted({r[0] for r in kept})[-window:]
        kept = [r for r in kept if r[0] in dates]
    x, y = np.array([[r[i] or 0.0 for i in cols] for r in kept]), np.array([r[label] for r in kept])
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 10 * np.eye(len(cols)), xc.T @ yc)
    return len(kept), min(r[0] for r in kept), y.mean() - x.mean(0) @ w, w


def test_each_horizon_equals_its_own_fit(spark, rows, panel):
    """Own features, window and labels by horizon; names that are left out, null and NaN labels, a null feature."""
    gone = spark.createDataFrame([(7,), (7,), (99,)], "ticker_id long")
    train = D.training_rows(panel, SPECS, F.lit(DAYS[11]), {"1M": "y_1M", "3M": "y_3M"}, gone)
    got = {r.horizon: r for r in D.fit_horizons(train, SPECS).join(D.train_windows(train), "horizon").collect()}
    for h, cols, label in (("1M", (2, 3), 5), ("3M", (3, 4), 6)):
        n, start, b0, w = expected(rows, cols, label, SPECS[h]["window"], {7})
        assert (got[h].n_rows, got[h].start) == (n, start)
        assert np.allclose([got[h].intercept, *got[h].coefficients], [b0, *w], atol=1e-9)


def test_no_rows_give_no_models(spark, panel):
    train = D.training_rows(panel, SPECS, F.lit(DAYS[0]), {"1M": "y_1M", "3M": "y_3M"})
    assert D.fit_horizons(train, SPECS).count() == 0
    assert D.train_windows(train).count() == 0


def test_scores_blend_overlay_and_smoothing(spark):
    current = spark.createDataFrame([(DAYS[11], t, float(t), 0.0, 0.0, 0.1 * t, 0.9 if t == 3 else 0.1, 0.9 if t == 3 else 0.1) for t in (1, 2, 3)], "date date, ticker_id long, a double, b double, c double, knife_score double, vol_p double, downtrend_p double")
    models = spark.createDataFrame([("1M", 0.0, [1.0, 0.0]), ("3M", 0.0, [0.0, 0.0])], D.MODELS)
    get = lambda df: {(r.horizon, r.ticker_id): (round(r.raw_rank, 6), round(r["rank"], 6), r.tier) for r in df.collect()}
    got = get(D.score_horizons(current, models, SPECS))
    assert [got["1M", t] for t in (1, 2, 3)] == [(0.0, 0.0, "none"), (0.5, 0.5, "none"), (1.0, 1.0, "high")]
    # all tie before the overlay, which then ranks by risk
    assert [got["3M", t][:2] for t in (1, 2, 3)] == [(0.5, 1.0), (0.5, 0.5), (0.5, 0.0)]
    prior = spark.createDataFrame([(1, "3M", 0.0), (3, "3M", 0.9)], "ticker_id long, horizon string, prior_rank double")
    # 0.5 * 1 + 0.5 * 0 and, without a stored rank, 0.5 tie; 0.5 * 0 + 0.5 * 0.9 is last
    assert [get(D.score_horizons(current, models, SPECS, prior))["3M", t][1] for t in (1, 2, 3)] == [0.75, 0.75, 0.0]
    second = spark.createDataFrame([("1M", t, -float(t)) for t in (1, 2, 3)], "horizon string, ticker_id long, pred double")
    assert {v[0] for k, v in get(D.score_horizons(current, models, {"1M": SPECS["1M"]}, second=second, weight=0.5)).items()} == {0.5}
    alone = D.score_horizons(current.filter("ticker_id = 2"), models, SPECS)
    assert {(r.raw_rank, r["rank"]) for r in alone.collect()} == {(0.5, 0.5)}


def test_trees_find_a_planted_step_and_nothing_in_noise(spark):
    rng = np.random.default_rng(5)
    rows = [(DAYS[i % 12], i, *map(float, rng.normal(size=3))) for i in range(2000)]
    df = spark.createDataFrame([(*r[:4], 2.0 * (r[2] > 0.3) + 0.1 * r[4], r[4]) for r in rows], "date date, ticker_id long, a double, b double, y double, noise double")
    train, test = df.filter("ticker_id < 1500"), df.filter("ticker_id >= 1500")
    for label, low, high in (("y", 0.9, 1.0), ("noise", -0.2, 0.2)):
        out = M.predict(M.fit_trees(train, ["a", "b"], label, seeds=2), test, ["a", "b"])
        assert low <= out.select(F.corr("pred", label)).first()[0] <= high


def test_ranks_within_groups_replace_those_of_the_date(spark):
    """Groups of five or more, sector before industry; other columns, small groups and null groups keep the rank of the date."""
    rows = [(DAYS[0], t, "s1" if t < 6 else ("s2" if t < 9 else None), "i1" if t < 6 and t != 1 else None, float(t), float(-t)) for t in range(1, 12)]
    p = spark.createDataFrame(rows, "date date, ticker_id long, sector string, industry string, u double, w double")
    got = {r.ticker_id: (round(r.u, 6), round(r.w, 6)) for r in X.rank_normalize(p, ["u", "w"], ("sector", "industry"), relative_columns=("u",)).collect()}
    assert [got[t][0] for t in range(1, 6)] == [-1.0, -0.5, 0.0, 0.5, 1.0]
    assert [got[t][0] for t in range(6, 12)] == [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
    assert [got[t][1] for t in (1, 6, 11)] == [1.0, 0.0, -1.0]
