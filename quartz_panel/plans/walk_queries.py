"""Queries and SQL of walk-forward evaluation: ridge folds from Gram matrices, penalty path, permutation null."""

from __future__ import annotations

from pyspark.sql import functions as F

from quartz_panel.operators import crosssection as X
from quartz_panel.operators import gram as G
from quartz_panel.operators import price as P
from quartz_panel.operators.cut import cut

from . import panel as L
from .evaluation_queries import TURN, ic_sql
from .factor_queries import _KNIFE_Q, KNIFE, knife_panel, oracle, rounded, sql_rank
from .registry import query

#: Features of the folds whose coefficients SQL has in closed form; months of training before the first test date, penalties, seeds.
FEATURES = ["mom_6m", "vol_120d"]
MIN_TRAIN, ALPHAS, SEEDS = 12, (1.0, 10.0, 100.0), tuple(range(1, 21))
LAMBDA, SPAN, WEIGHT = 0.2, 3, 0.3


def _rows(spark, d):
    """The panel of the knife queries with its label, cut: folds, scores and permutations read it."""
    p = knife_panel(spark, d).withColumn("r", F.round("r_3M", 8) + 0.0)
    return cut(p.withColumn("y", F.when(F.col("mask_3M"), F.col("r"))).drop("r_3M"))


def _folds(p, window=None):
    return G.folds_of(p, P.HORIZONS["3M"], MIN_TRAIN, window)


DATES = ("wf_dates", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM knife)")
ROWS = ("wf_rows", "SELECT *, round(r_3M, 8) + 0.0 AS r FROM knife WHERE mask_3M")
TARGETS = ("wf_targets", "SELECT *, (rank() OVER (PARTITION BY date ORDER BY r) + (count(*) OVER (PARTITION BY date, r) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS y_rank FROM wf_rows")
FOLDS = ("wf_folds", "SELECT t.date AS test_date, c.date AS cutoff, t.i FROM wf_dates t JOIN wf_dates c ON c.i = t.i - 3 WHERE t.i >= 15")


def fit_sql(y: str, source: str, alphas=(10.0,), window: int | None = None, by: str = "") -> str:
    """Ridge of two features in closed form for each fold and penalty."""
    low = f" AND p.date >= (SELECT date FROM wf_dates WHERE i = greatest(f.i - 3 - {window}, 0))" if window else ""
    by = by and by + ", "
    return f"""SELECT {by}test_date, alpha, n, m - b1 * m1 - b2 * m2 AS b0, b1, b2 FROM (SELECT *, (y1 * (s22 + alpha) - y2 * s12) / det AS b1, (y2 * (s11 + alpha) - y1 * s12) / det AS b2 FROM (SELECT *, (s11 + alpha) * (s22 + alpha) - s12 * s12 AS det FROM (
  SELECT {by}test_date, count(*) AS n, avg(mom_6m) AS m1, avg(vol_120d) AS m2, avg({y}) AS m, covar_pop(mom_6m, {y}) * count(*) AS y1, covar_pop(vol_120d, {y}) * count(*) AS y2, var_pop(mom_6m) * count(*) AS s11, var_pop(vol_120d) * count(*) AS s22, covar_pop(mom_6m, vol_120d) * count(*) AS s12
  FROM wf_folds f JOIN {source} p ON p.date <= f.cutoff{low} GROUP BY {by}test_date) CROSS JOIN (VALUES {", ".join(f"({a}::DOUBLE)" for a in alphas)}) AS v(alpha)))"""


SCORE = "round(b0 + b1 * mom_6m + b2 * vol_120d, 9)"
BASE = (_KNIFE_Q, KNIFE, DATES, ROWS, FOLDS)


@query("m07_ridge_folds", oracle(f"SELECT test_date, n AS n_train, round(b0, 5) + 0.0 AS intercept, round(b1, 5) + 0.0 AS b_mom, round(b2, 5) + 0.0 AS b_vol FROM ({fit_sql('r', 'wf_rows', window=24)})", *BASE))
def _(spark, d):
    """Coefficients of each fold of a rolling window of 24 month ends."""
    p = _rows(spark, d)
    m = G.ridge_folds(p, FEATURES, "y", _folds(p, 24))
    return rounded(m.select("test_date", "n_train", "intercept", F.col("coefficients")[0].alias("b_mom"), F.col("coefficients")[1].alias("b_vol")), digits=5)


_MIXED = (
    ("wf_a", fit_sql("r", "wf_rows")),
    ("wf_b", fit_sql("y_rank", "wf_targets")),
    ("wf_pred", f"SELECT p.*, a.pred AS pa, b.pred AS pb FROM wf_rows p JOIN (SELECT p.date, ticker_id, {SCORE} AS pred FROM wf_rows p JOIN wf_a ON p.date = test_date) a ON p.date = a.date AND p.ticker_id = a.ticker_id JOIN (SELECT p.date, ticker_id, {SCORE} AS pred FROM wf_rows p JOIN wf_b ON p.date = test_date) b ON p.date = b.date AND p.ticker_id = b.ticker_id"),
    ("wf_all", f"SELECT *, round({1 - WEIGHT} * {sql_rank('pa')} + {WEIGHT} * {sql_rank('pb')}, 9) AS pred FROM wf_pred"),
    ("wf_mix", f"SELECT * FROM wf_all WHERE date IN (SELECT date FROM ({ic_sql('wf_all')}))"),
    ("wf_raw", f"SELECT *, {sql_rank('pred')} AS raw_rank, {sql_rank('knife_score')} AS k FROM wf_mix"),
    ("wf_over", f"SELECT *, {sql_rank('b')} AS over_ FROM (SELECT *, round({1 - LAMBDA} * raw_rank - {LAMBDA} * k, 9) AS b FROM wf_raw)"),
    ("wf_steps", "SELECT *, row_number() OVER (PARTITION BY ticker_id ORDER BY date) AS step FROM wf_over"),
    ("wf_walk", "WITH RECURSIVE walk AS (SELECT ticker_id, date, step, over_ AS s FROM wf_steps WHERE step = 1 UNION ALL SELECT r.ticker_id, r.date, r.step, 0.5 * r.over_ + 0.5 * w.s FROM walk w JOIN wf_steps r ON r.ticker_id = w.ticker_id AND r.step = w.step + 1) SELECT ticker_id, date, round(s, 9) AS rank FROM walk"),
    ("wf_final", "SELECT o.*, w.rank, dense_rank() OVER (ORDER BY o.date) AS di FROM wf_over o JOIN wf_walk w ON o.ticker_id = w.ticker_id AND o.date = w.date"),
)


def _summary_sql(source: str, by: str = "") -> str:
    """The columns of walk_forward_summary over ranks with a dense date number ``di``."""
    keys, lead = (f"{by}, date", f"{by}, ") if by else ("date", "")
    turn = lambda v: TURN.format(by=lead, by2=f"a.{by}, " if by else "", v=v, t=source, on=f" AND a.{by} = b.{by}" if by else "", group=f" GROUP BY {by}" if by else "")
    on = lambda t: f"ON u.{by} = {t}.{by}" if by else "ON true"
    sector = f"SELECT {keys}, avg(ic) AS ic FROM ({ic_sql(source, keys + ', sector', 'rank', 3)}) GROUP BY {keys}"
    group = f" GROUP BY {by}" if by else ""
    return f"""SELECT {f"u.{by}, " if by else ""}u.n, round(u.mean, 6) + 0.0 AS mean, round(u.std, 6) AS std, round(u.mean / u.std, 6) + 0.0 AS icir, round(u.mean / (u.std / sqrt(u.n)), 5) + 0.0 AS t, round(u.hit, 6) AS hit_rate, round(s.ic, 6) + 0.0 AS sector_ic, round(s.icir, 6) + 0.0 AS sector_icir, round(r.turnover, 6) AS turnover_raw, round(f.turnover, 6) AS turnover
  FROM (SELECT {lead}count(*) AS n, avg(ic) AS mean, stddev_samp(ic) AS std, avg((ic > 0)::INT) AS hit FROM ({ic_sql(source, keys, 'rank')}){group}) u JOIN (SELECT {lead}avg(ic) AS ic, avg(ic) / stddev_samp(ic) AS icir FROM ({sector}){group}) s {on("s")} JOIN ({turn("raw_rank")}) r {on("r")} JOIN ({turn("rank")}) f {on("f")}"""


def _summary(ranks, by=()):
    out = G.walk_forward_summary(ranks, by, 3, 5)
    return rounded(out.withColumn("t", F.round("t", 5)))


@query("m07_walk_forward_ranks", oracle(_summary_sql("wf_final"), *BASE, TARGETS, *_MIXED))
def _(spark, d):
    """Two ridges (of the return and of its rank) blended, the knife overlay, smoothing; IC by date, within sectors, and turnover before and after."""
    p = _rows(spark, d)
    folds, labelled = _folds(p), p.filter("mask_3M")
    ranked = X.target_rank(p.withColumn("r_3M", F.col("r")), "3M").drop("r_3M")
    a, b = (G.scored(labelled, FEATURES, G.ridge_folds(t, FEATURES, y, folds)) for t, y in ((p, "y"), (ranked, "y_rank")))
    return _summary(G.walk_forward_ranks(G.blended(a.drop("alpha", "n_train"), b, WEIGHT), "r", 5, LAMBDA, SPAN))


_PATH = (
    ("wf_fits", fit_sql("r", "wf_rows", ALPHAS)),
    ("wf_scored", f"SELECT p.*, alpha, {SCORE} AS pred FROM wf_rows p JOIN wf_fits ON p.date = test_date"),
    ("wf_kept", f"SELECT s.* FROM wf_scored s JOIN ({ic_sql('wf_scored', 'alpha, date')}) i ON s.date = i.date AND s.alpha = i.alpha"),
    ("wf_path", f"SELECT *, raw_rank AS rank, dense_rank() OVER (ORDER BY date) AS di FROM (SELECT *, {sql_rank('pred', 'alpha, date')} AS raw_rank FROM wf_kept)"),
)


@query("m12_regularisation_sweep", oracle(_summary_sql("wf_path", "alpha"), *BASE, *_PATH))
def _(spark, d):
    """All penalties over all folds, from one eigendecomposition of each fold's Gram matrix."""
    p = _rows(spark, d)
    models = G.ridge_folds(p, FEATURES, "y", _folds(p), ALPHAS).drop("n_train")
    return _summary(G.walk_forward_ranks(G.scored(p.filter("mask_3M"), FEATURES, models), "r", 5, by=("alpha",)), ("alpha",))


_NULL = (
    ("wf_places", "SELECT date, mom_6m, vol_120d, row_number() OVER (PARTITION BY date ORDER BY ticker_id) AS k FROM wf_rows"),
    ("wf_deals", f"SELECT seed, date, r, row_number() OVER (PARTITION BY seed, date ORDER BY md5(seed || ':' || strftime(date, '%Y-%m-%d') || ':' || ticker_id), ticker_id) AS k FROM wf_rows CROSS JOIN (SELECT unnest(range({SEEDS[0]}, {SEEDS[-1] + 1})) AS seed)"),
    ("wf_dealt", "SELECT seed, a.date, mom_6m, vol_120d, r FROM wf_places a JOIN wf_deals b ON a.date = b.date AND a.k = b.k"),
    ("wf_null", f"SELECT p.date, p.ticker_id, p.r, seed, {SCORE} AS pred FROM wf_rows p JOIN ({fit_sql('r', 'wf_dealt', by='seed')}) ON p.date = test_date"),
    ("wf_real", f"SELECT p.date, p.ticker_id, p.r, {SCORE} AS pred FROM wf_rows p JOIN ({fit_sql('r', 'wf_rows')}) ON p.date = test_date"),
)


@query(
    "m09_permutation_null",
    oracle(f"""SELECT reps, round(real, 6) + 0.0 AS real, round(null_mean, 6) + 0.0 AS null_mean, round(null_std, 6) AS null_std, round((real - null_mean) / null_std, 4) + 0.0 AS z, CASE WHEN (real - null_mean) / null_std > 2 THEN 'beyond the null' ELSE 'within the null' END AS verdict
  FROM (SELECT avg(ic) AS real FROM ({ic_sql('wf_real')})) CROSS JOIN (SELECT count(*) AS reps, avg(m) AS null_mean, stddev_samp(m) AS null_std FROM (SELECT seed, avg(ic) AS m FROM ({ic_sql('wf_null', 'seed, date')}) GROUP BY seed))""", *BASE, *_NULL),
)
def _(spark, d):
    """Mean IC of the folds against 20 refits on labels permuted within dates."""
    from quartz_panel.operators import evaluate as E

    p = _rows(spark, d)
    folds, rows = _folds(p), p.filter("mask_3M")
    real = E.rank_ic(G.scored(rows, FEATURES, G.ridge_folds(p, FEATURES, "y", folds)), 5)
    null = E.rank_ic(G.scored(rows, FEATURES, G.permuted_folds(p, FEATURES, "y", folds, list(SEEDS))), 5, ("seed", "date"))
    out = G.null_verdict(real, null)
    return rounded(out.withColumn("z", F.round("z", 4)))


@query("m07_walk_forward_ic")
def _(spark, d):
    """Each horizon by its specification: target, features, window, overlay and smoothing; ridge on all features of the prepared panel."""
    panel, out = L.prepared_panel(spark, d, targets={h: s["target"] for h, s in L.HORIZON_SPECS.items()}), None
    for h, spec in L.HORIZON_SPECS.items():
        features = L.feature_columns(spec["packs"], spec.get("extra", ()))
        p = L.targeted(panel, h, spec["target"])
        models = G.ridge_folds(p, features, "y", G.folds_of(p, P.HORIZONS[h], MIN_TRAIN, spec["window"]))
        ranks = G.walk_forward_ranks(G.scored(p.filter(f"mask_{h}"), features, models), f"r_{h}", 5, spec["knife_lambda"], spec["span"])
        one = _summary(ranks).withColumn("horizon", F.lit(h))
        out = one if out is None else out.unionByName(one)
    return out
