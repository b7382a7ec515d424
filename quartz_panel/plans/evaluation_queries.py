"""Queries and SQL of the evaluation operators; a factor stands for the prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from quartz_panel.operators import crosssection as X
from quartz_panel.operators import evaluate as E
from quartz_panel.operators import price as P
from quartz_panel.sources import views as V

from . import panel as L
from .factor_queries import _KNIFE_Q, KNIFE, knife_panel, oracle, rounded, sql_rank
from .registry import query

#: Predictions: a factor, against the three-month return.
PRED = ("pred", "SELECT k.*, round(mom_6m, 8) AS pred, round(r_3M, 8) + 0.0 AS r FROM knife k WHERE mask_3M")
VIEWS = (_KNIFE_Q, KNIFE, PRED)


def predictions(spark, d):
    return knife_panel(spark, d).filter("mask_3M").withColumn("pred", F.col("mom_6m")).withColumn("r", F.round("r_3M", 8) + 0.0)


def _avg_rank(v: str, by: str) -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0"


def ic_sql(source: str = "pred", by: str = "date", score: str = "pred", least: int = 5) -> str:
    return f"""SELECT {by}, covar_pop(qa, qb) / (stddev_pop(qa) * stddev_pop(qb)) AS ic, count(*) AS n FROM (SELECT *, {_avg_rank(score, by)} AS qa, {_avg_rank("r", by)} AS qb FROM {source})
  GROUP BY {by} HAVING count(*) >= {least} AND stddev_pop(qa) * stddev_pop(qb) > 0"""


IC = ("ics", ic_sql())


@query("a03_rank_ic", oracle("SELECT date, round(ic, 6) + 0.0 AS ic, n FROM ics", *VIEWS, IC))
def _(spark, d):
    return rounded(E.rank_ic(predictions(spark, d), 5))


@query("a04_within_sector_ic", oracle(f"SELECT date, round(avg(ic), 6) + 0.0 AS ic, count(*) AS groups FROM ({ic_sql(by='date, sector', least=3)}) GROUP BY date", *VIEWS))
def _(spark, d):
    return rounded(E.within_group_ic(predictions(spark, d), "sector", 3))


@query("a05_ic_summary", oracle("SELECT count(*) AS n, round(avg(ic), 6) AS mean, round(stddev_samp(ic), 6) AS std, round(avg(ic) / stddev_samp(ic), 6) AS icir, round(avg(ic) / (stddev_samp(ic) / sqrt(count(*))), 5) AS t, round(avg((ic > 0)::INT), 6) AS hit_rate FROM ics", *VIEWS, IC))
def _(spark, d):
    out = E.ic_summary(E.rank_ic(predictions(spark, d), 5))
    return rounded(out.withColumn("t", F.round("t", 5)))


@query("a06_block_bootstrap", oracle("SELECT count(*)::INT AS n, round(avg(ic), 6) AS mean, round(stddev_samp(ic), 6) AS std, round(avg(ic) / (stddev_samp(ic) / sqrt(greatest(count(*) / 3.0::DOUBLE, 1.0))), 5) AS t_block FROM ics", *VIEWS, IC))
def _(spark, d):
    return rounded(E.block_bootstrap(E.rank_ic(predictions(spark, d), 5), 3, reps=0).withColumn("t_block", F.round("t_block", 5)))


@query("a06_block_bootstrap_resampled")
def _(spark, d):
    return rounded(E.block_bootstrap(E.rank_ic(predictions(spark, d), 5), 3, reps=500))


RISK = """SELECT {by}avg(knife) AS knife, avg(vol) AS vol, avg(downtrend) AS downtrend, avg(mean_r) AS mean_r, avg(downside) AS downside, avg(tail) AS tail, count(*) AS dates FROM (
  SELECT {by}date, avg(knife_score) AS knife, avg(vol_p) AS vol, avg((round(downtrend_p, 9) > 0.5)::INT) AS downtrend, avg(r) AS mean_r, sqrt(avg(least(r, 0) * least(r, 0))) AS downside, avg((r < tq)::INT) AS tail FROM (
    SELECT *, row_number() OVER (PARTITION BY {by}date ORDER BY {rank} DESC, ticker_id) AS rn, count(*) OVER (PARTITION BY {by}date) AS n, quantile_cont(r, 0.1) OVER (PARTITION BY {by}date) AS tq FROM {source}) WHERE rn <= ceil(n * 0.1) GROUP BY {by}date)"""


@query("a07_top_decile_risk", oracle("SELECT round(knife, 6) AS knife, round(vol, 6) AS vol, round(downtrend, 6) AS downtrend, round(mean_r, 6) AS mean_r, round(downside, 6) AS downside, round(tail, 6) AS tail, dates FROM (" + RISK.format(by="", rank="pred", source="pred") + ")", *VIEWS))
def _(spark, d):
    return rounded(E.top_decile_risk(predictions(spark, d)))


_CORR = """SELECT candidate, feature, round(m, 6) AS mean_abs, row_number() OVER (PARTITION BY candidate ORDER BY m DESC, feature)::INT AS place FROM (
  SELECT candidate, feature, avg(abs(c)) AS m FROM (SELECT a.date, a.f AS candidate, b.f AS feature, CASE WHEN stddev_pop(a.k) * stddev_pop(b.k) > 0 THEN covar_pop(a.k, b.k) / (stddev_pop(a.k) * stddev_pop(b.k)) END AS c FROM ranked a JOIN ranked b ON a.date = b.date AND a.ticker_id = b.ticker_id
  WHERE a.f = 'mom_6m' AND b.f <> 'mom_6m' GROUP BY ALL) GROUP BY ALL) QUALIFY place <= 3"""
RANKED = ("ranked", f"SELECT date, ticker_id, f, {_avg_rank('v', 'date, f')} AS k FROM (UNPIVOT (SELECT date, ticker_id, mom_6m, vol_60d, ma_gap_200, dist_low_252, er FROM kq) ON mom_6m, vol_60d, ma_gap_200, dist_low_252, er INTO NAME f VALUE v)")


@query("a08_feature_correlations", oracle(_CORR, _KNIFE_Q, RANKED))
def _(spark, d):
    return rounded(E.feature_correlations(knife_panel(spark, d), ["mom_6m"], ["vol_60d", "ma_gap_200", "dist_low_252", "er"]))


@query("a09_regime_ic", oracle(f"""SELECT tertile, round(avg(ic), 6) + 0.0 AS ic, count(*) AS dates FROM ({ic_sql("(SELECT p.*, CASE WHEN er <= e[1] THEN 0 WHEN er <= e[2] THEN 1 ELSE 2 END AS tertile FROM pred p JOIN (SELECT date, quantile_cont(er, [0.33333, 0.66667]) AS e FROM pred GROUP BY date) q ON p.date = q.date)".replace("p.*", "p.ticker_id, p.date, p.pred, p.r"), "date, tertile", least=3)}) GROUP BY tertile""", *VIEWS))
def _(spark, d):
    return rounded(E.regime_ic(predictions(spark, d), "er", 3))


@query("w24_sector_ranks", oracle("""SELECT ticker_id, CASE WHEN n >= 2 THEN round(1 - (rn - 1) / (n - 1)::DOUBLE, 6) END AS sector_pct, CASE WHEN n >= 2 THEN rn || '/' || n END AS sector_label FROM (
  SELECT ticker_id, row_number() OVER (PARTITION BY sector ORDER BY pred DESC, ticker_id) AS rn, count(*) OVER (PARTITION BY sector) AS n FROM pred WHERE date = (SELECT max(date) FROM pred))""", *VIEWS))
def _(spark, d):
    p = predictions(spark, d)
    last = p.join(p.agg(F.max("date").alias("date")), "date")
    return rounded(E.sector_ranks(last, "pred").select("ticker_id", "sector_pct", "sector_label"))


RANKS = ("rk", f"SELECT *, {sql_rank('pred')} AS rank, row_number() OVER (PARTITION BY ticker_id ORDER BY date) AS i, dense_rank() OVER (ORDER BY date) AS di FROM pred")
_EWMA = """WITH RECURSIVE walk AS (SELECT ticker_id, date, i, rank AS smooth FROM rk0 WHERE i = 1 UNION ALL SELECT r.ticker_id, r.date, r.i, 0.5 * r.rank + 0.5 * w.smooth FROM walk w JOIN rk0 r ON r.ticker_id = w.ticker_id AND r.i = w.i + 1)
SELECT ticker_id, date, round(smooth, 6) AS smooth FROM walk"""


def _ranked(spark, d):
    return X.rank01(predictions(spark, d), ["date"], "pred", "rank")


@query("w25_ewma_rank", oracle("SELECT ticker_id, date, smooth FROM walk_all", *VIEWS, RANKS, ("walk_all", _EWMA.replace("rk0", "rk"))))
def _(spark, d):
    return rounded(E.ewma_rank(_ranked(spark, d), 3).select("ticker_id", "date", "smooth"))


TURN = "SELECT {by}avg(m) AS turnover FROM (SELECT {by2}a.di, avg(abs(a.{v} - b.{v})) AS m FROM {t} a JOIN {t} b ON a.ticker_id = b.ticker_id AND b.di = a.di + 1{on} GROUP BY ALL){group}"


@query("w26_rank_turnover", oracle("SELECT round(turnover, 6) AS turnover FROM (" + TURN.format(by="", by2="", v="rank", t="rk", on="", group="") + ")", *VIEWS, RANKS))
def _(spark, d):
    return rounded(E.rank_turnover(_ranked(spark, d)))


SWEEP = (
    "sweep",
    f"""SELECT *, CASE WHEN lam <= 0 THEN rank ELSE {sql_rank('b', 'lam, date')} END AS over_ FROM (SELECT *, round((1 - lam) * rank - lam * k, 9) AS b FROM (
  SELECT r.*, lam, {sql_rank('knife_score', 'lam, date')} AS k FROM rk r CROSS JOIN (VALUES (0.0::DOUBLE), (0.2), (0.5)) AS l(lam)))""",
)


@query(
    "m10_knife_sweep",
    oracle(f"""SELECT a.lam, round(a.ic, 6) + 0.0 AS ic, round(b.turnover, 6) AS turnover, round(c.knife, 6) AS knife FROM (SELECT lam, avg(ic) AS ic FROM ({ic_sql('sweep', 'lam, date', 'over_')}) GROUP BY lam) a
  JOIN ({TURN.format(by='lam, ', by2='a.lam, ', v='over_', t='sweep', on=' AND a.lam = b.lam', group=' GROUP BY lam')}) b ON a.lam = b.lam JOIN ({RISK.format(by='lam, ', rank='over_', source='sweep')} GROUP BY lam) c ON a.lam = c.lam""", *VIEWS, RANKS, SWEEP),
)
def _(spark, d):
    return rounded(E.knife_sweep(_ranked(spark, d), [0.0, 0.2, 0.5]))


BLEND = ("blend", f"""SELECT r.date, r.ticker_id, r.r, r.di, w, round((1 - w) * rank + w * coalesce(rb, rank), 9) AS mixed FROM rk r LEFT JOIN (SELECT date, ticker_id, {sql_rank('mom_1m')} AS rb FROM pred WHERE ticker_id % 4 <> 0) o ON r.date = o.date AND r.ticker_id = o.ticker_id
  CROSS JOIN (VALUES (0.0::DOUBLE), (0.25), (0.5)) AS ws(w)""")


@query("m11_blend_sweep", oracle(f"SELECT a.w, round(a.ic, 6) + 0.0 AS ic, round(b.turnover, 6) AS turnover FROM (SELECT w, avg(ic) AS ic FROM ({ic_sql('blend', 'w, date', 'mixed')}) GROUP BY w) a JOIN ({TURN.format(by='w, ', by2='a.w, ', v='mixed', t='blend', on=' AND a.w = b.w', group=' GROUP BY w')}) b ON a.w = b.w", *VIEWS, RANKS, BLEND))
def _(spark, d):
    p = predictions(spark, d)
    return rounded(E.blend_sweep(p, p.filter("ticker_id % 4 <> 0").withColumn("pred", F.col("mom_1m")), [0.0, 0.25, 0.5]))


query("j12_fold_match", oracle("SELECT date, ticker_id, round(mixed, 6) AS mixed FROM blend WHERE w = 0.5", *VIEWS, RANKS, BLEND))(
    lambda spark, d: _fold_match(spark, d)
)


def _fold_match(spark, d):
    a = _ranked(spark, d)
    b = X.rank01(predictions(spark, d).filter("ticker_id % 4 <> 0"), ["date"], "mom_1m", "rb")
    return rounded(E.matched_mix(a, b, "rank", "rb", 0.5, "mixed").select("date", "ticker_id", "mixed"))


@query("x20_rank_blend", oracle(f"SELECT date, ticker_id, round(0.7 * {sql_rank('pred')} + 0.3 * {sql_rank('mom_1m')}, 6) AS blended FROM pred", *VIEWS))
def _(spark, d):
    return rounded(X.blend_ranks(predictions(spark, d), ["date"], "pred", "mom_1m", 0.3, "blended").select("date", "ticker_id", "blended"))


@query("x21_cross_horizon_shrink", oracle(f"""SELECT date, ticker_id, '6M' AS horizon, round({sql_rank('pred')}, 6) AS rank FROM pred UNION ALL
  SELECT date, ticker_id, '1Y', round({sql_rank('m')}, 6) FROM (SELECT date, ticker_id, round(0.7 * {sql_rank('mom_1m')} + 0.3 * {sql_rank('pred')}, 9) AS m FROM pred)""", *VIEWS))
def _(spark, d):
    p = predictions(spark, d)
    long = X.rank01(p, ["date"], "pred", "rank").select("date", "ticker_id", F.lit("6M").alias("horizon"), "rank").unionByName(X.rank01(p, ["date"], "mom_1m", "rank").select("date", "ticker_id", F.lit("1Y").alias("horizon"), "rank"))
    return rounded(E.cross_horizon_shrink(long))


@query("x22_rank_smoothing", oracle(f"""SELECT ticker_id, horizon, round({sql_rank('s', 'horizon')}, 6) AS rank FROM (SELECT c.ticker_id, '6M' AS horizon, round(coalesce(0.5 * c.rank + 0.5 * p.rank, c.rank), 9) AS s
  FROM (SELECT * FROM rk WHERE di = (SELECT max(di) FROM rk)) c LEFT JOIN (SELECT ticker_id, arg_max(rank, date) AS rank FROM rk WHERE di < (SELECT max(di) FROM rk) GROUP BY ticker_id) p ON c.ticker_id = p.ticker_id)""", *VIEWS, RANKS))
def _(spark, d):
    r = _ranked(spark, d).withColumn("horizon", F.lit("6M"))
    last = F.broadcast(r.agg(F.max("date").alias("last")))
    now = r.join(last, r.date == last["last"]).select("ticker_id", "horizon", "rank")
    prior = r.join(last, r.date < last["last"]).groupBy("ticker_id", "horizon").agg(F.max_by("rank", "date").alias("prior_rank"))
    return rounded(E.smooth_to_prior(now, prior, 3))


def _stored(spark, d):
    """Stored predictions: ticker_id, horizon, as_of_date, created_at, rank; some dates stored twice."""
    r = _ranked(spark, d).select("ticker_id", F.lit("6M").alias("horizon"), F.col("date").alias("as_of_date"), F.lit(1).alias("created_at"), "rank")
    return r.unionByName(r.filter("month(as_of_date) = 6").withColumn("created_at", F.lit(2)).withColumn("rank", F.col("rank") / 2))


STORED = ("stored", "SELECT ticker_id, '6M' AS horizon, date AS as_of_date, 1 AS created_at, rank FROM rk UNION ALL SELECT ticker_id, '6M', date, 2, rank / 2 FROM rk WHERE month(date) = 6")
PRIOR = ("priors", "SELECT *, row_number() OVER (PARTITION BY ticker_id, horizon ORDER BY as_of_date DESC) AS rn FROM (SELECT * FROM stored WHERE as_of_date < DATE '2001-01-01' QUALIFY row_number() OVER (PARTITION BY ticker_id, horizon, as_of_date ORDER BY created_at DESC) = 1)")


@query("w29_prior_ranks", oracle("SELECT ticker_id, horizon, rn::INT AS rn, as_of_date, round(rank, 6) AS rank FROM priors WHERE rn <= 2", *VIEWS, RANKS, STORED, PRIOR))
def _(spark, d):
    return rounded(E.prior_ranks(_stored(spark, d), "2001-01-01", 2).select("ticker_id", "horizon", "rn", "as_of_date", "rank"))


@query("w30_rank_stability", oracle("SELECT ticker_id, horizon, round(CASE WHEN count(*) >= 2 THEN stddev_pop(rank) END, 6) AS stability FROM priors WHERE rn <= 3 GROUP BY ticker_id, horizon", *VIEWS, RANKS, STORED, PRIOR))
def _(spark, d):
    p = E.prior_ranks(_stored(spark, d), "2001-01-01", 3)
    return rounded(E.rank_stability(p))


LONG = ("long", "SELECT date, ticker_id, h AS horizon, mask, r, up AS y, s AS r_hat, 1 / (1 + exp(-s)) AS prob FROM (" + " UNION ALL ".join(f"SELECT date, ticker_id, '{h}' AS h, mask_{h} AS mask, round(r_{h}, 8) + 0.0 AS r, up_{h} AS up, round(mom_1m, 8) + 0.0 AS s FROM panel" for h in P.HORIZONS) + ")")


def melted(spark, d):
    p = L.price_panel(spark, d)
    bars = P.forward_targets(V.bars(spark, d)).select("ticker_id", F.col("trade_date").alias("bar_date"), *(f"up_{h}" for h in P.HORIZONS))
    p = p.join(bars, ["ticker_id", "bar_date"])
    s = F.round("mom_1m", 8) + 0.0
    parts = F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"mask_{h}").alias("mask"), (F.round(f"r_{h}", 8) + 0.0).alias("r"), F.col(f"up_{h}").alias("y")) for h in P.HORIZONS))
    return p.select("date", "ticker_id", s.alias("r_hat"), (1 / (1 + F.exp(-s))).alias("prob"), F.explode(parts).alias("x")).select("date", "ticker_id", "r_hat", "prob", "x.*")


@query("a14_return_scale", oracle("SELECT horizon, round(CASE WHEN count(*) FILTER (mask) <= 1 THEN 1.0 ELSE greatest(stddev_pop(r) FILTER (mask), 1e-4) END, 6) AS scale FROM long GROUP BY horizon", LONG))
def _(spark, d):
    return rounded(E.return_scale(melted(spark, d)))


@query("a14_class_weights", oracle("SELECT horizon, y, round(raw / avg(raw) OVER (PARTITION BY horizon), 6) AS weight FROM (SELECT horizon, y, pow(count(*) / (sum(count(*)) OVER (PARTITION BY horizon))::DOUBLE, -0.5) AS raw FROM long WHERE mask GROUP BY horizon, y)", LONG))
def _(spark, d):
    return rounded(E.class_weights(melted(spark, d)))


@query(
    "a15_prediction_metrics",
    oracle(f"""SELECT m.horizon, n, round(acc, 6) AS accuracy, round(brier, 6) AS brier, round(base, 6) AS base_rate, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(acc - greatest(base, 1 - base), 6) + 0.0 AS lift, round(ic, 6) + 0.0 AS ic FROM (
  SELECT horizon, count(*) AS n, avg(((prob >= 0.5) = y)::INT) AS acc, avg((prob - y::INT) * (prob - y::INT)) AS brier, avg(y::INT) AS base, sqrt(avg((r_hat - r) * (r_hat - r))) AS rmse, avg(abs(r_hat - r)) AS mae FROM long WHERE mask GROUP BY horizon) m
  LEFT JOIN (SELECT horizon, avg(ic) AS ic FROM ({ic_sql('(SELECT * FROM long WHERE mask)', 'horizon, date', 'r_hat', 5)}) GROUP BY horizon) i ON m.horizon = i.horizon""", LONG),
)
def _(spark, d):
    return rounded(E.prediction_metrics(melted(spark, d), 5))


@query("m04_walk_forward_folds", oracle("SELECT t.date AS test_date, c.date AS cutoff, l.date AS lower FROM d t JOIN d c ON c.i = t.i - 3 JOIN d l ON l.i = greatest(t.i - 3 - 24, 0) WHERE t.i >= 15", ("d", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM panel)")))
def _(spark, d):
    return E.walk_forward_folds(L.price_panel(spark, d).select("date"), 63, 12, 24)


@query("m01_time_split", oracle("SELECT date, ticker_id, CASE WHEN date < DATE '2001-11-30' - INTERVAL 18 MONTH THEN 'train' WHEN date < DATE '2001-11-30' - INTERVAL 6 MONTH THEN 'val' ELSE 'holdout' END AS part FROM panel"))
def _(spark, d):
    return L.price_panel(spark, d).select("date", "ticker_id", E.time_part("date", F.lit("2001-11-30").cast("date"), 18, 6).alias("part"))


@query("m02_strided_samples", oracle("SELECT p.ticker_id, p.trade_date, p.pos FROM px p JOIN targets t USING (ticker_id, trade_date) WHERE pos >= 252 AND (pos - 252) % 5 = 0 AND (mask_1M OR mask_3M OR mask_6M OR mask_1Y)"))
def _(spark, d):
    b = P.forward_targets(P.bar_index(V.bars(spark, d)))
    return E.strided_samples(b, 252, 5, [f"mask_{h}" for h in P.HORIZONS]).select("ticker_id", "trade_date", F.col("pos").cast("long").alias("pos"))


@query("m03_aligned_samples", oracle("SELECT g.date, n.ticker_id, b.trade_date AS bar_date, b.pos FROM (SELECT DISTINCT ticker_id FROM bars) n CROSS JOIN grid g ASOF JOIN px b ON n.ticker_id = b.ticker_id AND g.date >= b.trade_date WHERE b.pos >= 252"))
def _(spark, d):
    return L.grid_bars(V.bars(spark, d), max_stale_days=None).select("date", "ticker_id", "bar_date", F.col("pos").cast("long").alias("pos"))


@query("a18_train_window_facts", oracle("SELECT min(date) AS start, max(date) AS \"end\", count(*) AS n_rows, count(DISTINCT ticker_id) AS names FROM panel WHERE mask_3M"))
def _(spark, d):
    return E.window_facts(L.price_panel(spark, d).filter("mask_3M"))
