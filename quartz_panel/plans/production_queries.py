"""Queries and SQL of production models: all horizons fitted and scored by their specifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from quartz_panel.operators import crosssection as X
from quartz_panel.operators import evaluate as E
from quartz_panel.operators import price as P
from quartz_panel.operators import production as D
from quartz_panel.operators.cut import cut
from quartz_panel.sources import views as V

from . import panel as L
from .factor_queries import _gap, oracle, rounded, sql_rank
from .registry import query

#: The specifications with two features, whose fits SQL has in closed form.
PAIR = ["mom_6m", "vol_120d"]
PAIR_SPECS = {h: {**s, "features": PAIR} for h, s in L.HORIZON_SPECS.items()}
#: The specifications with all their features.
SPECS = {h: {**s, "features": L.feature_columns(s["packs"], s.get("extra", ()))} for h, s in L.HORIZON_SPECS.items()}
AS_OF = "2001-11-30"

_R = ", ".join(f"round(r_{h}, 8) + 0.0 AS r_{h}, mask_{h}" for h in P.HORIZONS)
PANEL = ("pr_panel", f"SELECT date, ticker_id, sector, {', '.join(f'round({c}, 8) + 0.0 AS {c}' for c in (*PAIR, 'ma_gap_200', 'dist_low_252'))}, {_R} FROM panel")
KNIFE = ("pr_knife", f"SELECT *, v AS vol_p, 1 - (t + l) / 2 AS downtrend_p, round(v * (1 - (t + l) / 2), 9) AS knife_score FROM (SELECT *, {sql_rank('vol_120d')} AS v, {sql_rank('ma_gap_200')} AS t, {sql_rank('dist_low_252')} AS l FROM pr_panel)")


def _label(h: str, mode: str) -> str:
    if mode == "rank":
        return f"(rank() OVER (PARTITION BY date, mask_{h} ORDER BY r_{h}) + (count(*) OVER (PARTITION BY date, mask_{h}, r_{h}) - 1) / 2.0) / count(*) OVER (PARTITION BY date, mask_{h})"
    return _gap(f"r_{h}", "sector", f"mask_{h}")


_LABELLED = " UNION ALL ".join(f"SELECT '{h}' AS horizon, {s['window'] or 'NULL'}::INT AS win, date, ticker_id, mom_6m AS x1, vol_120d AS x2, {_label(h, s['target'])} AS y, mask_{h} AS labelled FROM pr_knife" for h, s in PAIR_SPECS.items())
ROWS = ("pr_rows", f"SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY horizon ORDER BY date DESC) AS dk FROM ({_LABELLED}) WHERE labelled AND date < DATE '{AS_OF}' AND ticker_id NOT IN (SELECT ticker_id FROM tickers WHERE user_added)) WHERE win IS NULL OR dk <= win")
FITS = (
    "pr_fits",
    """SELECT horizon, start, "end", n, names, m - b1 * m1 - b2 * m2 AS b0, b1, b2 FROM (SELECT *, (y1 * (s22 + 10) - y2 * s12) / det AS b1, (y2 * (s11 + 10) - y1 * s12) / det AS b2 FROM (SELECT *, (s11 + 10) * (s22 + 10) - s12 * s12 AS det FROM (
  SELECT horizon, min(date) AS start, max(date) AS "end", count(*) AS n, count(DISTINCT ticker_id) AS names, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS m, covar_pop(x1, y) * count(*) AS y1, covar_pop(x2, y) * count(*) AS y2, var_pop(x1) * count(*) AS s11, var_pop(x2) * count(*) AS s22, covar_pop(x1, x2) * count(*) AS s12
  FROM pr_rows GROUP BY horizon)))""",
)


def _panel(spark, d):
    p = L.price_panel(spark, d).select("date", "ticker_id", "sector", *PAIR, "ma_gap_200", "dist_low_252", *(f"{k}_{h}" for h in P.HORIZONS for k in ("r", "mask")))
    return cut(X.knife_score(rounded(p, digits=8)))


def _labelled(p):
    for h, spec in L.HORIZON_SPECS.items():
        p = L.targeted(p, h, spec["target"], f"y_{h}")
    return p


def _trained(spark, d, p, specs):
    user = V.tickers(spark, d).filter("user_added")
    return D.training_rows(_labelled(p), specs, F.lit(AS_OF).cast("date"), {h: f"y_{h}" for h in specs}, user)


@query("m13_horizon_models", oracle("SELECT horizon, start, \"end\", n AS n_rows, names, round(b0, 5) + 0.0 AS intercept, round(b1, 5) + 0.0 AS b_mom, round(b2, 5) + 0.0 AS b_vol FROM pr_fits", PANEL, KNIFE, ROWS, FITS))
def _(spark, d):
    """Each horizon's model on its own target and window, user-added names left out, with the window it was trained on."""
    rows = cut(_trained(spark, d, _panel(spark, d), PAIR_SPECS))
    m = D.fit_horizons(rows, PAIR_SPECS).join(D.train_windows(rows), "horizon")
    return rounded(m.select("horizon", "start", "end", "n_rows", "names", "intercept", F.col("coefficients")[0].alias("b_mom"), F.col("coefficients")[1].alias("b_vol")), digits=5)


def _prior(p, last):
    """Stored ranks of the date before, here the percentile of six-month momentum; every fifth name has none."""
    before = F.broadcast(p.join(last, p.date < last.last).agg(F.max("date").alias("date")))
    old = X.rank01(p.join(before, "date"), ["date"], "mom_6m", "prior_rank").filter("ticker_id % 5 <> 0")
    return old.select("ticker_id", F.explode(F.array(*map(F.lit, L.HORIZON_SPECS))).alias("horizon"), "prior_rank")


_LAST = "(SELECT max(date) FROM pr_knife)"
PRIOR = ("pr_prior", f"SELECT ticker_id, {sql_rank('mom_6m')} AS prior_rank FROM pr_knife WHERE date = (SELECT max(date) FROM pr_knife WHERE date < {_LAST})")


def _scored_sql(h: str, spec: dict) -> str:
    lam, span = spec["knife_lambda"], spec["span"]
    raw = f"SELECT k.*, '{h}' AS horizon, {sql_rank('s', 'date')} AS raw_rank, {sql_rank('knife_score', 'date')} AS kr FROM (SELECT k.*, round(b0 + b1 * mom_6m + b2 * vol_120d, 9) AS s FROM pr_knife k, pr_fits f WHERE f.horizon = '{h}' AND k.date = {_LAST}) k"
    over = f"SELECT *, {sql_rank('b', 'date') if lam > 0 else 'raw_rank'} AS o FROM (SELECT *, round({1 - lam} * raw_rank - {lam} * kr, 9) AS b FROM ({raw}))"
    alpha = 2 / (span + 1)
    last = f"SELECT *, {sql_rank('z', 'date')} AS rank FROM (SELECT q.*, round(coalesce({alpha} * o + {1 - alpha} * p.prior_rank, o), 9) AS z FROM ({over}) q LEFT JOIN (SELECT * FROM pr_prior WHERE ticker_id % 5 <> 0) p ON q.ticker_id = p.ticker_id)" if span > 0 else f"SELECT *, o AS rank FROM ({over})"
    return f"SELECT date, ticker_id, horizon, round(raw_rank, 6) AS raw_rank, round(rank, 6) AS rank, CASE WHEN round(vol_p, 9) >= 0.8 AND round(downtrend_p, 9) >= 0.8 THEN 'high' WHEN round(vol_p, 9) >= 0.6 AND round(downtrend_p, 9) >= 0.6 THEN 'elevated' ELSE 'none' END AS tier FROM ({last})"


@query("m14_horizon_scores", oracle(" UNION ALL ".join(_scored_sql(h, s) for h, s in PAIR_SPECS.items()), PANEL, KNIFE, ROWS, FITS, PRIOR))
def _(spark, d):
    """The last cross-section scored by every horizon's model, with overlay and a smoothing step from stored ranks."""
    p = _panel(spark, d)
    last = F.broadcast(p.agg(F.max("date").alias("last")))
    models = cut(D.fit_horizons(_trained(spark, d, p, PAIR_SPECS), PAIR_SPECS))
    current = cut(p.join(last, p.date == last.last, "left_semi"))
    return rounded(D.score_horizons(current, models, PAIR_SPECS, _prior(p, last)))


@query("m14_production_scores")
def _(spark, d):
    """All features of each horizon's specification, on the prepared panel; the longest horizon is shrunk toward the one before it."""
    p = L.prepared_panel(spark, d, targets={h: s["target"] for h, s in SPECS.items()})
    last = F.broadcast(p.agg(F.max("date").alias("last")))
    models = cut(D.fit_horizons(_trained(spark, d, p, SPECS), SPECS))
    current = cut(p.join(last, p.date == last.last, "left_semi"))
    ranks = D.score_horizons(current, models, SPECS)
    shrunk = E.cross_horizon_shrink(ranks.select("date", "ticker_id", "horizon", "rank"))
    return rounded(ranks.drop("rank").join(shrunk, ["date", "ticker_id", "horizon"]))
