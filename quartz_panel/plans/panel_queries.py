"""Queries and SQL of the whole panel: every feature, ranked features with all labels, ranks within sector and industry."""

from __future__ import annotations

from pyspark.sql import functions as F

from quartz_panel.operators import crosssection as X
from quartz_panel.operators import price as P
from quartz_panel.sources import views as V

from . import panel as L
from .factor_queries import DATED, EST, GROWTH, MEDIANS, STABILITY, TTM, _gap, _r, oracle, rounded, sql_rank
from .registry import ORACLES, query
from .service_queries import DAILY, ROLL

FEATURES = L.all_features()

_RATIO = "CASE WHEN abs({b}) > 1e-9 THEN {a} / {b} ELSE 0 END"
_FUNDS = {
    "revenue_growth": "g.revenue_growth", "gross_margin": "g.gross_margin", "operating_margin": "g.operating_margin",
    "debt_equity": _RATIO.format(a="g.total_debt", b="g.total_equity"), "fcf_revenue": _RATIO.format(a="g.fcf", b="g.revenue"), "total_equity": "g.total_equity",
    "ttm_revenue": "t.ttm_revenue", "ttm_net_income": "t.ttm_net_income", "ttm_fcf": "t.ttm_fcf",
    **{f"{c}_stability_4q": f"s.{c}_stability_4q" for c in ("gross_margin", "operating_margin", "revenue_growth")},
}
_VALUES = {
    "earnings_yield": ("ttm_net_income", "cap"), "book_to_market": ("total_equity", "cap"), "sales_to_price": ("ttm_revenue", "cap"), "fcf_yield": ("ttm_fcf", "cap"),
    "roe_ttm": ("ttm_net_income", "total_equity"), "net_margin_ttm": ("ttm_net_income", "ttm_revenue"), "fcf_margin_ttm": ("ttm_fcf", "ttm_revenue"),
}
#: The price panel with each further table as it was known on the date; the filing and analyst parts are the SQL of w17, x17 and x19.
FULL = (
    GROWTH, TTM, STABILITY, EST, DAILY, ROLL,
    ("fp_filed", "SELECT g.ticker_id, g.filed_at, g.accession_number, " + ", ".join(f"{e} AS {c}" for c, e in _FUNDS.items()) + " FROM growth g JOIN ttm t ON g.accession_number = t.accession_number JOIN stability s ON g.accession_number = s.accession_number"),
    ("fp_funds", "SELECT p.*, p.adj_close * p.shares_outstanding AS cap, (f.accession_number IS NOT NULL)::INT::DOUBLE AS fund_available, " + ", ".join(f"coalesce(f.{c}, 0) AS {c}" for c in _FUNDS) + " FROM panel p ASOF LEFT JOIN fp_filed f ON p.ticker_id = f.ticker_id AND p.date >= f.filed_at"),
    ("fp_values", "SELECT *, " + ", ".join(f"{_RATIO.format(a=a, b=b)} AS {c}" for c, (a, b) in _VALUES.items()) + f", {_gap('mom_12_1', 'industry')} AS industry_neutral_mom_12_1 FROM fp_funds"),
    ("fp_reaction", ORACLES["w17_filing_reaction"]), ("fp_analysts", ORACLES["x17_estimate_features"]), ("fp_shorts", ORACLES["x19_short_ratio"]),
    ("fp_mood", "SELECT p.ticker_id, p.date, CASE WHEN p.date - r.score_date <= 3 THEN rolling_7d ELSE 0 END AS sentiment_7d, CASE WHEN p.date - r.score_date <= 3 THEN rolling_14d ELSE 0 END AS sentiment_14d FROM panel p ASOF LEFT JOIN rolled r ON p.ticker_id = r.ticker_id AND p.date >= r.score_date"),
    ("fp_joined", "SELECT *, coalesce(CASE WHEN adj_close > 0 AND target <> 0 THEN (target - adj_close) / adj_close END, 0) AS price_target_upside FROM fp_values JOIN (SELECT ticker_id, date, price_target_mean_0 AS target FROM est) USING (ticker_id, date) JOIN fp_reaction USING (ticker_id, date) JOIN fp_analysts USING (ticker_id, date) JOIN fp_shorts USING (ticker_id, date) JOIN fp_mood USING (ticker_id, date)"),
    ("fp_full", f"SELECT date, ticker_id, sector, industry, {_r(' '.join(FEATURES))}, " + ", ".join(f"r_{h}, mask_{h}" for h in P.HORIZONS) + " FROM fp_joined"),
)


def _full(spark, d):
    """The panel with features of six digits, so that equal ones tie in both engines."""
    keep = ["date", "ticker_id", "sector", "industry", *(f"{k}_{h}" for h in P.HORIZONS for k in ("r", "mask"))]
    p = L.full_panel(spark, d)
    return rounded(p.select(*keep, *FEATURES), *(c for c in keep if c.startswith("r_")))


@query("x01_full_panel", oracle(f"SELECT date, ticker_id, sector, industry, {', '.join(FEATURES)}, {_r(' '.join(f'r_{h}' for h in P.HORIZONS))}, {', '.join(f'mask_{h}' for h in P.HORIZONS)} FROM fp_full", *FULL))
def _(spark, d):
    """Every feature of every pack, with returns and masks."""
    return rounded(_full(spark, d), *FEATURES)  # features are rounded already


_RANKED = ("fp_ranked", "SELECT p.date, p.ticker_id, sector, " + ", ".join(f"{sql_rank(c, by='p.date', one='0.0', lo='-1.0', width='2.0')} AS {c}" for c in FEATURES) + ", vol_120d AS vol_120d_raw, " + ", ".join(f"coalesce(mask_{h} AND m_{h}.median IS NOT NULL, false) AS mask_{h}, CASE WHEN mask_{h} AND m_{h}.median IS NOT NULL THEN r_{h} - m_{h}.median ELSE 0 END AS r_{h}" for h in P.HORIZONS) + " FROM fp_full p " + " ".join(f"LEFT JOIN medians m_{h} ON p.date = m_{h}.trade_date AND m_{h}.horizon = '{h}'" for h in P.HORIZONS))
#: r_h of nine digits, as labels rank by them
_LABELLED = ("fp_labelled", "SELECT * REPLACE (" + ", ".join(f"round(r_{h}, 9) + 0.0 AS r_{h}" for h in P.HORIZONS) + ") FROM fp_ranked")
_PREPARED = (*FULL, DATED, MEDIANS, _RANKED, _LABELLED)


def _label(h: str, mode: str) -> str:
    if mode == "rank":
        return f"CASE WHEN mask_{h} THEN (rank() OVER (PARTITION BY date, mask_{h} ORDER BY r_{h}) + (count(*) OVER (PARTITION BY date, mask_{h}, r_{h}) - 1) / 2.0) / count(*) OVER (PARTITION BY date, mask_{h}) END"
    return f"CASE WHEN mask_{h} THEN {_gap(f'r_{h}', 'sector', f'mask_{h}')} END"


_KNIFE = "(vol_120d + 1) / 2 * (1 - ((ma_gap_200 + 1) / 2 + (dist_low_252 + 1) / 2) / 2)"


@query(
    "x15_prepared_features",
    oracle(f"SELECT date, ticker_id, sector, {_r(' '.join(FEATURES))}, round({_KNIFE}, 9) AS knife_score, round(vol_120d_raw, 6) AS vol_120d_raw, {_r(' '.join(f'r_{h}' for h in P.HORIZONS))}, {', '.join(f'mask_{h}' for h in P.HORIZONS)}, "
           + ", ".join(f"round({_label(h, s['target'])}, 6) + 0.0 AS y_{h}" for h, s in L.HORIZON_SPECS.items()) + " FROM fp_labelled", *_PREPARED),
)
def _(spark, d):
    """The panel that models read: ranks of all features, knife score, demeaned returns, and each horizon's label by its specification."""
    p = L.prepared(_full(spark, d), L.panel_medians(spark, d), targets={h: s["target"] for h, s in L.HORIZON_SPECS.items()}, digits=9)
    labels = (F.col(f"label_{h}").alias(f"y_{h}") for h in P.HORIZONS)
    p = p.withColumn("knife_score", F.round("knife_score", 9))
    return rounded(p.select("date", "ticker_id", "sector", *FEATURES, "knife_score", "vol_120d_raw", *(f"{k}_{h}" for h in P.HORIZONS for k in ("r", "mask")), *labels), "knife_score")


_RELATIVE = ["mom_6m", "vol_20d", "ma_gap_50", "max_ret_21d"]


def _relative_sql(c: str) -> str:
    """Rank of the date, replaced by that of the sector and then of the industry where the group is big enough."""
    anew = lambda g, v: f"CASE WHEN {g} IS NOT NULL AND count({v}) OVER (PARTITION BY date, {g}) >= 5 THEN {sql_rank(v, f'date, {g}', '0.0', '-1.0', '2.0')} ELSE {v} END"
    if c not in L.feature_columns(base=L.RELATIVE_PACKS):
        return f"SELECT date, ticker_id, {sql_rank(c, one='0.0', lo='-1.0', width='2.0')} AS v FROM xr"
    first = f"SELECT *, {sql_rank(c, one='0.0', lo='-1.0', width='2.0')} AS v0 FROM xr"
    second = f"SELECT *, round({anew('sector', 'v0')}, 9) AS v1 FROM (SELECT * REPLACE (round(v0, 9) AS v0) FROM ({first}))"
    return f"SELECT date, ticker_id, {anew('industry', 'v1')} AS v FROM ({second})"


@query(
    "x05_industry_relative",
    oracle("SELECT x0.date, x0.ticker_id, " + ", ".join(f"round(x{i}.v, 6) + 0.0 AS {c}" for i, c in enumerate(_RELATIVE)) + f" FROM ({_relative_sql(_RELATIVE[0])}) x0 " + " ".join(f"JOIN ({_relative_sql(c)}) x{i} ON x0.date = x{i}.date AND x0.ticker_id = x{i}.ticker_id" for i, c in enumerate(_RELATIVE) if i),
           ("xr", "SELECT date, ticker_id, sector, industry, " + ", ".join(f"round({c}, 8) + 0.0 AS {c}" for c in _RELATIVE) + " FROM panel")),
)
def _(spark, d):
    """Ranks within sector and industry where a feature's pack allows it; the largest daily return keeps its rank of the date."""
    p = rounded(L.price_panel(spark, d).select("date", "ticker_id", "sector", "industry", *_RELATIVE), digits=8)
    out = X.rank_normalize(p, _RELATIVE, ("sector", "industry"), relative_columns=tuple(L.feature_columns(base=L.RELATIVE_PACKS)))
    return rounded(out.select("date", "ticker_id", *_RELATIVE))
