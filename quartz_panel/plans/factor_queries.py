"""Queries and SQL of the as-of, factor, fundamental and cross-section operators."""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import functions as F

from quartz_panel.functions import scalar as S
from quartz_panel.operators import crosssection as X
from quartz_panel.operators import fundamentals as U
from quartz_panel.operators import price as P
from quartz_panel.operators.asof import asof_join, lagged_asof
from quartz_panel.sources import views as V

from . import panel as L
from .registry import query


def rounded(df, *keys, digits: int = 6):
    """Doubles rounded, so that the order of a sum doesn't show; -0.0 becomes 0.0.

    They are scaled before they are rounded, as SQL does it, so that halves such as 0.0000255, which is a little less as a double, go the same way."""
    kinds = dict(df.dtypes)
    told = [c for c in df.columns if kinds[c] == "double" and c not in keys]
    if len(told) > 40:  # as one expression these would be a method too long to be compiled
        return df.mapInArrow(partial(_rounded_batches, columns=told, digits=digits), df.schema)
    scale = F.lit(10.0**digits)

    def whole(x):
        """The nearest whole number, halves away from 0; without a decimal for each value, as round() makes one."""
        a = F.abs(x)
        low = F.when(a < 2.0**52, F.floor(a).cast("double")).otherwise(a)  # larger ones are whole
        near = low + F.when(a - low >= 0.5, 1.0).otherwise(0.0)
        return F.when(x < 0, -near).otherwise(near)

    return df.select(*((whole(F.col(c) * scale) / scale + 0.0).alias(c) if c in told else F.col(c) for c in df.columns))


def _rounded_batches(batches, columns, digits):
    for batch in batches:
        for c in columns:
            out = X._half_up(batch[c].to_numpy(zero_copy_only=False), digits)
            batch = batch.set_column(batch.schema.get_field_index(c), batch.schema.field(c), pa.array(out, mask=batch[c].is_null().to_numpy(zero_copy_only=False)))
        yield batch


FACTOR_VIEWS = (
    ("px", "SELECT b.*, row_number() OVER w - 1 AS pos, lag(adj_close) OVER w AS prev FROM bars b WINDOW w AS (PARTITION BY ticker_id ORDER BY trade_date)"),
    ("ret", "SELECT *, CASE WHEN adj_close > 0 AND prev > 0 THEN ln(adj_close / prev) END AS daily FROM px"),
    ("market", "SELECT trade_date, avg(daily) AS mkt FROM ret WHERE daily IS NOT NULL GROUP BY trade_date"),
    ("fx", "SELECT ret.*, coalesce(daily, 0) AS s, mkt, t.shares_outstanding, t.sector, t.industry FROM ret LEFT JOIN market USING (trade_date) JOIN tickers t USING (ticker_id)"),
    (
        "raw_factors",
        """SELECT ticker_id, trade_date, pos, adj_close, shares_outstanding, sector, industry, adj_close AS p, lag(adj_close, 21) OVER w AS p21, lag(adj_close, 42) OVER w AS p42, lag(adj_close, 63) OVER w AS p63, lag(adj_close, 84) OVER w AS p84,
  lag(adj_close, 105) OVER w AS p105, lag(adj_close, 126) OVER w AS p126, lag(adj_close, 252) OVER w AS p252, count(mkt) OVER w251 AS n, coalesce(covar_pop(s, mkt) OVER w251, 0) AS cov, var_pop(mkt) OVER w251 AS vy,
  var_pop(CASE WHEN mkt IS NOT NULL THEN s END) OVER w251 AS vx, CASE WHEN count(daily) OVER w20 > 1 THEN stddev_pop(daily) OVER w20 ELSE 0 END AS vol_20d, CASE WHEN count(daily) OVER w60 > 1 THEN stddev_pop(daily) OVER w60 ELSE 0 END AS vol_60d,
  CASE WHEN count(daily) OVER w120 > 1 THEN stddev_pop(daily) OVER w120 ELSE 0 END AS vol_120d, max(daily) OVER w21 AS mx, max(adj_close) OVER w252 AS hi, min(adj_close) OVER w252 AS lo, avg(adj_close) OVER w50 AS ma50, avg(adj_close) OVER w200 AS ma200,
  avg(volume) OVER w20 AS v20, avg(volume) OVER w60 AS v60, avg(volume) OVER w120 AS v120, count(daily) OVER w120 AS n120, avg(daily) OVER w120 AS m1, avg(daily * daily) OVER w120 AS m2, avg(daily * daily * daily) OVER w120 AS m3,
  avg(least(daily, 0) * least(daily, 0)) OVER w120 AS dn, sum(daily) OVER w120 AS sm, sum(abs(daily)) OVER w120 AS sa, avg(CASE WHEN adj_close * volume > 0 THEN abs(daily) / (adj_close * volume) END) OVER w60 AS il,
  coalesce(sum(mkt) OVER (PARTITION BY ticker_id ORDER BY trade_date ROWS BETWEEN 251 PRECEDING AND 21 PRECEDING), 0) AS k12, coalesce(sum(mkt) OVER (PARTITION BY ticker_id ORDER BY trade_date ROWS BETWEEN 125 PRECEDING AND CURRENT ROW), 0) AS k6
  FROM fx WINDOW w AS (PARTITION BY ticker_id ORDER BY trade_date), """
        + ", ".join(f"w{n} AS (PARTITION BY ticker_id ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (20, 21, 50, 60, 120, 200, 251, 252)),
    ),
    (
        "factors",
        """SELECT *, CASE WHEN n >= 60 THEN sqrt(greatest(vx - 2 * beta_252d * cov + beta_252d * beta_252d * vy, 0)) ELSE vol_120d END AS idio_vol, mom_12_1 - beta_252d * k12 AS resid_mom_12_1, mom_6m - beta_252d * k6 AS resid_mom_6m, mom_3m - mom_6m AS mom_accel_3_6 FROM (
  SELECT *, ln(p / p21) AS mom_1m, ln(p / p63) AS mom_3m, ln(p / p126) AS mom_6m, ln(p21 / p252) AS mom_12_1, CASE WHEN n >= 60 AND vy > 1e-12 THEN cov / vy ELSE 0 END AS beta_252d, ln(p * shares_outstanding) AS log_market_cap,
  exp(mx) - 1 AS max_ret_21d, ln(p / hi) AS dist_high_252, ln(p / lo) AS dist_low_252, ln(p / ma50) AS ma_gap_50, ln(p / ma200) AS ma_gap_200, ln(v20 / v120) AS vol_trend,
  CASE WHEN n120 >= 20 AND vol_120d > 1e-12 THEN (m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / (vol_120d * vol_120d * vol_120d) ELSE 0 END AS ret_skew_120d, CASE WHEN n120 >= 20 AND vol_120d > 1e-12 THEN sqrt(dn) / vol_120d ELSE 0 END AS downside_vol_ratio_120d,
  CASE WHEN n120 >= 20 AND sa > 1e-12 THEN abs(sm) / sa ELSE 0 END AS efficiency_ratio_120d, coalesce(il * 1e6, 0) AS amihud_illiq_60d, v60 / shares_outstanding AS turnover_60d,
  ((p > p21)::INT + (p21 > p42)::INT + (p42 > p63)::INT + (p63 > p84)::INT + (p84 > p105)::INT + (p105 > p126)::INT) / 6.0::DOUBLE AS mom_consistency_6m
  FROM raw_factors WHERE pos >= 252)""",
    ),
    (
        "grid_bars",
        """SELECT g.date, n.ticker_id, b.trade_date AS bar_date, b.pos, b.adj_close FROM (SELECT DISTINCT ticker_id FROM bars) n CROSS JOIN grid g ASOF JOIN px b ON n.ticker_id = b.ticker_id AND g.date >= b.trade_date
  WHERE b.pos >= 252 AND g.date - b.trade_date <= 7""",
    ),
    (
        "targets",
        "SELECT ticker_id, trade_date, "
        + ", ".join(f"coalesce(ln(lead(adj_close, {n}) OVER w / adj_close), 0) AS r_{h}, lead(adj_close, {n}) OVER w IS NOT NULL AS mask_{h}, coalesce(lead(adj_close, {n}) OVER w > adj_close, false) AS up_{h}" for h, n in P.HORIZONS.items())
        + " FROM bars WINDOW w AS (PARTITION BY ticker_id ORDER BY trade_date)",
    ),
    ("panel", "SELECT g.date, g.bar_date, f.*, t.* EXCLUDE (ticker_id, trade_date) FROM grid_bars g JOIN factors f ON g.ticker_id = f.ticker_id AND g.bar_date = f.trade_date JOIN targets t ON g.ticker_id = t.ticker_id AND g.bar_date = t.trade_date"),
)


def oracle(body: str, *more) -> str:
    return V.sql(body, *FACTOR_VIEWS, *more)


def _r(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns.split())


def _factors(spark, d):
    return P.price_factors(V.bars(spark, d), V.tickers(spark, d))


#: name of the query, its factors
FACTORS = {
    "w02_momentum": "mom_1m mom_3m mom_6m mom_12_1",
    "w03_beta": "beta_252d",
    "w04_realized_vol": "vol_20d vol_60d vol_120d",
    "w05_max_ret": "max_ret_21d",
    "w06_idio_vol": "idio_vol",
    "w07_range_distance": "dist_high_252 dist_low_252",
    "w08_ma_gap": "ma_gap_50 ma_gap_200",
    "w09_volume_trend": "vol_trend",
    "w10_higher_moments": "ret_skew_120d downside_vol_ratio_120d efficiency_ratio_120d",
    "w11_amihud": "amihud_illiq_60d",
    "w12_turnover": "turnover_60d",
    "w13_residual_momentum": "resid_mom_12_1 resid_mom_6m mom_accel_3_6",
    "w14_momentum_consistency": "mom_consistency_6m",
    "p09_log_market_cap": "log_market_cap",
}
for _name, _cols in FACTORS.items():
    query(_name, oracle(f"SELECT ticker_id, trade_date, {_r(_cols)} FROM factors"))(lambda spark, d, cols=_cols: rounded(_factors(spark, d).select("ticker_id", "trade_date", *cols.split())))


@query("w01_bar_index", oracle("SELECT ticker_id, trade_date, pos FROM px WHERE pos >= 252"))
def _(spark, d):
    return P.bar_index(V.bars(spark, d)).filter("pos >= 252").select("ticker_id", "trade_date", F.col("pos").cast("long").alias("pos"))


@query("w15_universe_returns", oracle("SELECT trade_date, round(mkt, 9) + 0.0 AS mkt FROM market"))
def _(spark, d):
    return rounded(P.universe_returns(V.bars(spark, d)), digits=9)


_HORIZONS = "(VALUES " + ", ".join(f"('{h}', {n})" for h, n in P.HORIZONS.items()) + ") AS hz(horizon, h)"
MARKET_R = (
    "market_r",
    f"""SELECT date, horizon, e.before - s.before AS market_r FROM (SELECT g.date, min(m.idx) AS idx FROM grid g JOIN (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS idx FROM market) m ON m.trade_date >= g.date GROUP BY g.date) f
  CROSS JOIN {_HORIZONS} JOIN cum s ON s.idx = f.idx JOIN cum e ON e.idx = f.idx + h""",
)
CUM = ("cum", "SELECT row_number() OVER (ORDER BY trade_date) - 1 AS idx, sum(mkt) OVER (ORDER BY trade_date) - mkt AS before FROM market UNION ALL SELECT count(*) AS idx, sum(mkt) AS before FROM market")


@query("w16_market_horizon_returns", oracle("SELECT date, horizon, round(market_r, 6) + 0.0 AS market_r FROM market_r", CUM, MARKET_R))
def _(spark, d):
    bars = V.bars(spark, d)
    return rounded(P.market_horizon_returns(P.universe_returns(bars), P.month_end_grid(bars)))


@query("w27_forward_targets", oracle("SELECT ticker_id, trade_date, " + ", ".join(f"round(r_{h}, 6) + 0.0 AS r_{h}, mask_{h}, up_{h}" for h in P.HORIZONS) + " FROM targets"))
def _(spark, d):
    return rounded(P.forward_targets(V.bars(spark, d)).drop("adj_close", "volume"))


MEDIANS = (
    "medians",
    f"""SELECT a.trade_date, horizon, median(ln(b.adj_close / a.adj_close)) AS median FROM dated a CROSS JOIN {_HORIZONS} JOIN dated b ON a.ticker_id = b.ticker_id AND b.idx = a.idx + h GROUP BY a.trade_date, horizon""",
)
DATED = ("dated", "SELECT *, dense_rank() OVER (ORDER BY trade_date) AS idx FROM bars")


@query("w28_forward_medians", oracle("SELECT trade_date, horizon, round(median, 6) + 0.0 AS median FROM medians", DATED, MEDIANS))
def _(spark, d):
    return rounded(P.forward_medians(V.bars(spark, d)))


@query(
    "w22_trailing_sharpe",
    oracle("""SELECT ticker_id, round(CASE WHEN count(r) >= 30 AND stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(252.0) END, 6) + 0.0 AS sharpe FROM (
  SELECT ticker_id, adj_close / lag(adj_close) OVER (PARTITION BY ticker_id ORDER BY trade_date) - 1 AS r FROM (
    SELECT *, row_number() OVER (PARTITION BY ticker_id ORDER BY trade_date DESC) AS rn FROM bars WHERE trade_date >= (SELECT max(trade_date) - 420 FROM bars)) WHERE rn <= 252) WHERE r IS NOT NULL GROUP BY ticker_id"""),
)
def _(spark, d):
    return rounded(P.trailing_sharpe(V.bars(spark, d)))


@query("a01_month_end_grid", oracle("SELECT date FROM grid"))
def _(spark, d):
    return P.month_end_grid(V.bars(spark, d))


@query("j04_grid_bars", oracle("SELECT date, ticker_id, bar_date, pos, adj_close FROM grid_bars"))
def _(spark, d):
    return L.grid_bars(V.bars(spark, d)).select("date", "ticker_id", "bar_date", F.col("pos").cast("long").alias("pos"), "adj_close")


def _probes(spark, d):
    return L.grid_bars(V.bars(spark, d)).select("ticker_id", "date", "pos")


@query("j01_asof_join", oracle("SELECT g.ticker_id, g.date, f.filed_at, f.accession_number, round(f.revenue, 4) AS revenue FROM grid_bars g ASOF LEFT JOIN (SELECT * FROM filings WHERE filing_type = '10-Q') f ON g.ticker_id = f.ticker_id AND g.date >= f.filed_at"))
def _(spark, d):
    right = V.filings(spark, d).filter("filing_type = '10-Q'").withColumn("filed", F.col("filed_at"))
    out = asof_join(_probes(spark, d).drop("pos"), right, ["ticker_id"], "date", "filed_at", ["filed", "accession_number", "revenue"], tie=["accession_number"])
    return rounded(out.withColumnRenamed("filed", "filed_at"), digits=4)


def _asof(alias: str, field: str, on: str, view: str, ts: str) -> str:
    return f" ASOF LEFT JOIN (SELECT * FROM {view} WHERE {field} IS NOT NULL) {alias} ON g.ticker_id = {alias}.ticker_id AND {on} >= {alias}.{ts}"


@query("j02_asof_per_column", oracle("SELECT g.ticker_id, g.date, a.rec_mean, b.fwd_pe, c.pt_num_estimates FROM grid_bars g" + "".join(_asof(a, f, "g.date", "estimates", "as_of_date") for a, f in (("a", "rec_mean"), ("b", "fwd_pe"), ("c", "pt_num_estimates")))))
def _(spark, d):
    return asof_join(_probes(spark, d).drop("pos"), V.estimates(spark, d), ["ticker_id"], "date", "as_of_date", ["rec_mean", "fwd_pe", "pt_num_estimates"], per_column=True)


@query("j03_lagged_asof", oracle("SELECT g.ticker_id, g.date, a.rec_mean AS rec_mean_0, b.rec_mean AS rec_mean_30, c.rec_mean AS rec_mean_90 FROM grid_bars g" + "".join(_asof(a, "rec_mean", f"g.date - {n}", "estimates", "as_of_date") for a, n in (("a", 0), ("b", 30), ("c", 90)))))
def _(spark, d):
    return lagged_asof(_probes(spark, d).drop("pos"), V.estimates(spark, d), ["ticker_id"], "date", "as_of_date", ["rec_mean"], {"0": 0, "30": 30, "90": 90})


DAILY = ("daily_mean", "SELECT ticker_id, CAST((published_at AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') + INTERVAL 8 HOUR AS DATE) AS score_date, round(avg(sentiment_score), 4) AS mean_score FROM headlines GROUP BY ALL")


@query("j06_filing_mask", oracle("SELECT g.ticker_id, g.date, EXISTS (SELECT 1 FROM filings f WHERE f.ticker_id = g.ticker_id AND f.filed_at <= g.date) AS has_filing FROM grid_bars g"))
def _(spark, d):
    f = V.filings(spark, d).withColumn("filed", F.col("filed_at"))
    return asof_join(_probes(spark, d).drop("pos"), f, ["ticker_id"], "date", "filed_at", ["filed"]).select("ticker_id", "date", F.col("filed").isNotNull().alias("has_filing"))


@query("j08_forward_asof", oracle("SELECT f.ticker_id, f.filed_at, b.trade_date, b.pos FROM (SELECT DISTINCT ticker_id, filed_at FROM filings) f ASOF LEFT JOIN px b ON f.ticker_id = b.ticker_id AND f.filed_at <= b.trade_date"))
def _(spark, d):
    b = P.bar_index(V.bars(spark, d)).withColumn("bar", F.col("trade_date"))
    out = asof_join(V.filings(spark, d).select("ticker_id", "filed_at").distinct(), b, ["ticker_id"], "filed_at", "trade_date", ["bar", "pos"], forward=True)
    return out.select("ticker_id", "filed_at", F.col("bar").alias("trade_date"), F.col("pos").cast("long").alias("pos"))


GROWTH = (
    "growth",
    """SELECT f.*, CASE WHEN f.revenue <> 0 AND abs(p.prior) > 1e-9 THEN (f.revenue - p.prior) / abs(p.prior) ELSE 0 END AS revenue_growth FROM filings f LEFT JOIN (
  SELECT a.accession_number, arg_min(b.revenue, (abs(b.period_end - (a.period_end - INTERVAL 1 YEAR)::DATE), b.filed_at, b.accession_number)) AS prior FROM filings a JOIN filings b ON a.ticker_id = b.ticker_id AND a.filing_type = b.filing_type
  AND abs(b.period_end - (a.period_end - INTERVAL 1 YEAR)::DATE) <= 30 GROUP BY a.accession_number) p ON f.accession_number = p.accession_number""",
)


@query("j07_prior_year_revenue", oracle("SELECT ticker_id, accession_number, filing_type, round(revenue_growth, 6) + 0.0 AS revenue_growth FROM growth", GROWTH))
def _(spark, d):
    return rounded(U.revenue_growth(V.filings(spark, d)).select("ticker_id", "accession_number", "filing_type", "revenue_growth"))


query("w20_revenue_growth", oracle("SELECT ticker_id, filed_at, accession_number, round(revenue_growth, 6) + 0.0 AS revenue_growth FROM growth", GROWTH))(
    lambda spark, d: rounded(U.revenue_growth(V.filings(spark, d)).select("ticker_id", "filed_at", "accession_number", "revenue_growth"))
)

def _ttm_sql(source: str) -> str:
    """Per metric: nulls take no place; of a period filed twice the latest filing counts."""
    each = """CASE WHEN f.filing_type = '10-K' THEN
  coalesce((SELECT k.{m} FROM {t} k WHERE k.ticker_id = f.ticker_id AND k.filing_type = '10-K' AND k.{m} IS NOT NULL AND (k.filed_at, k.accession_number) <= (f.filed_at, f.accession_number) ORDER BY k.filed_at DESC, k.accession_number DESC LIMIT 1), 0)
ELSE coalesce((SELECT CASE WHEN count(*) = 4 AND f.period_end - arg_min(period_end, filed) <= 380 THEN sum(v) END FROM (SELECT period_end, max(filed_at) AS filed, arg_max({m}, (filed_at, accession_number)) AS v FROM {t} q WHERE q.ticker_id = f.ticker_id
  AND q.filing_type = '10-Q' AND q.{m} IS NOT NULL AND (q.filed_at, q.accession_number) <= (f.filed_at, f.accession_number) GROUP BY period_end ORDER BY filed DESC LIMIT 4)),
  (SELECT k.{m} FROM {t} k WHERE k.ticker_id = f.ticker_id AND k.filing_type = '10-K' AND k.{m} IS NOT NULL AND (k.filed_at, k.accession_number) <= (f.filed_at, f.accession_number) AND abs(f.period_end - k.period_end) <= 380 ORDER BY k.filed_at DESC, k.accession_number DESC LIMIT 1), 0) END AS ttm_{m}"""
    return "SELECT f.*, " + ", ".join(each.format(m=m, t=source) for m in ("revenue", "net_income", "fcf")) + f" FROM {source} f"


TTM = ("ttm", _ttm_sql("filings"))
_TTM_OUT = "SELECT accession_number, round(ttm_revenue, 5) AS ttm_revenue, round(ttm_net_income, 5) AS ttm_net_income, round(ttm_fcf, 5) AS ttm_fcf FROM ttm"


@query("w18_ttm", oracle(_TTM_OUT, TTM))
def _(spark, d):
    return rounded(U.ttm(V.filings(spark, d)).select("accession_number", "ttm_revenue", "ttm_net_income", "ttm_fcf"), digits=5)


GAPS = ("gaps", "SELECT * REPLACE (CASE WHEN month(period_end) = 6 AND ticker_id % 3 = 0 THEN NULL ELSE net_income END AS net_income, CASE WHEN filing_type = '10-K' AND ticker_id % 2 = 0 THEN NULL ELSE fcf END AS fcf) FROM filings")


@query("w18_ttm_with_gaps", oracle(_TTM_OUT, GAPS, ("ttm", _ttm_sql("gaps"))))
def _(spark, d):
    """Filings of which some state no net income and some years no free cash flow."""
    gaps = V.filings(spark, d).withColumns({"net_income": F.when(~((F.month("period_end") == 6) & (F.col("ticker_id") % 3 == 0)), F.col("net_income")), "fcf": F.when(~((F.col("filing_type") == "10-K") & (F.col("ticker_id") % 2 == 0)), F.col("fcf"))})
    return rounded(U.ttm(gaps).select("accession_number", "ttm_revenue", "ttm_net_income", "ttm_fcf"), digits=5)


STABILITY = (
    "stability",
    "SELECT *, "
    + ", ".join(f"CASE WHEN count({f}) OVER w >= 2 THEN -stddev_pop({f}) OVER w ELSE 0 END AS {f}_stability_4q" for f in ("gross_margin", "operating_margin", "revenue_growth"))
    + " FROM growth WINDOW w AS (PARTITION BY ticker_id ORDER BY filed_at, accession_number ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)",
)


@query("w19_margin_stability", oracle("SELECT accession_number, " + _r("gross_margin_stability_4q operating_margin_stability_4q revenue_growth_stability_4q") + " FROM stability", GROWTH, STABILITY))
def _(spark, d):
    return rounded(U.margin_stability(U.revenue_growth(V.filings(spark, d))).select("accession_number", "gross_margin_stability_4q", "operating_margin_stability_4q", "revenue_growth_stability_4q"))


@query("p07_filing_ratios", oracle("SELECT accession_number, round(CASE WHEN abs(total_equity) > 1e-9 THEN total_debt / total_equity ELSE 0 END, 6) AS debt_equity, round(CASE WHEN abs(revenue) > 1e-9 THEN fcf / revenue ELSE 0 END, 6) + 0.0 AS fcf_revenue FROM filings"))
def _(spark, d):
    return rounded(U.filing_ratios(V.filings(spark, d)).select("accession_number", "debt_equity", "fcf_revenue"))


@query(
    "p08_valuation",
    oracle(
        """SELECT ticker_id, date, """ + _r("earnings_yield book_to_market sales_to_price fcf_yield roe_ttm net_margin_ttm fcf_margin_ttm") + """ FROM (SELECT *, ni / cap AS earnings_yield, eq / cap AS book_to_market, rev / cap AS sales_to_price, fc / cap AS fcf_yield,
  CASE WHEN abs(eq) > 1e-9 THEN ni / eq ELSE 0 END AS roe_ttm, CASE WHEN abs(rev) > 1e-9 THEN ni / rev ELSE 0 END AS net_margin_ttm, CASE WHEN abs(rev) > 1e-9 THEN fc / rev ELSE 0 END AS fcf_margin_ttm FROM (
  SELECT g.ticker_id, g.date, g.adj_close * t.shares_outstanding AS cap, coalesce(f.ttm_net_income, 0) AS ni, coalesce(f.total_equity, 0) AS eq, coalesce(f.ttm_revenue, 0) AS rev, coalesce(f.ttm_fcf, 0) AS fc
  FROM grid_bars g JOIN tickers t ON g.ticker_id = t.ticker_id ASOF LEFT JOIN ttm f ON g.ticker_id = f.ticker_id AND g.date >= f.filed_at))""",
        TTM,
    ),
)
def _(spark, d):
    g = L.grid_bars(V.bars(spark, d)).select("ticker_id", "date", "adj_close").join(F.broadcast(V.tickers(spark, d).select("ticker_id", "shares_outstanding")), "ticker_id")
    f = U.ttm(V.filings(spark, d))
    g = asof_join(g, f, ["ticker_id"], "date", "filed_at", ["total_equity", "ttm_revenue", "ttm_net_income", "ttm_fcf"], tie=["accession_number"])
    return rounded(U.valuation(g).select("ticker_id", "date", "earnings_yield", "book_to_market", "sales_to_price", "fcf_yield", "roe_ttm", "net_margin_ttm", "fcf_margin_ttm"))


@query(
    "w17_filing_reaction",
    oracle(
        """SELECT ticker_id, date, round(coalesce(CASE WHEN s1 > s0 THEN ln(ps1 / ps0) - (cs1 - cs0) END, 0), 6) + 0.0 AS filing_surprise_3d, round(coalesce(CASE WHEN d1 - d0 >= 5 THEN ln(pd1 / pd0) - (cd1 - cd0) END, 0), 6) + 0.0 AS filing_drift_30d,
  coalesce(date - filed_at, 0)::DOUBLE AS filings_recency_days, coalesce((SELECT count(*) FROM filings f WHERE f.ticker_id = q.ticker_id AND f.filed_at <= q.date AND f.filed_at >= q.date - 90), 0)::DOUBLE AS filings_in_90d FROM (
  SELECT r.*, a.adj_close AS ps0, a.c AS cs0, b.adj_close AS ps1, b.c AS cs1, x.adj_close AS pd0, x.c AS cd0, y.adj_close AS pd1, y.c AS cd1 FROM (
    SELECT g.ticker_id, g.date, g.pos, f.filed_at, CASE WHEN f.file_pos <= g.pos THEN greatest(f.file_pos - 1, 0) END AS s0, CASE WHEN f.file_pos <= g.pos THEN least(f.file_pos + 1, g.pos) END AS s1, CASE WHEN f.file_pos <= g.pos THEN f.file_pos + 1 END AS d0,
    CASE WHEN f.file_pos <= g.pos THEN least(f.file_pos + 31, g.pos) END AS d1 FROM grid_bars g ASOF LEFT JOIN (SELECT f.ticker_id, f.filed_at, b.pos AS file_pos FROM (SELECT DISTINCT ticker_id, filed_at FROM filings) f ASOF LEFT JOIN px b ON f.ticker_id = b.ticker_id AND f.filed_at <= b.trade_date) f
    ON g.ticker_id = f.ticker_id AND g.date >= f.filed_at) r
  LEFT JOIN cumb a ON a.ticker_id = r.ticker_id AND a.pos = r.s0 LEFT JOIN cumb b ON b.ticker_id = r.ticker_id AND b.pos = r.s1 LEFT JOIN cumb x ON x.ticker_id = r.ticker_id AND x.pos = r.d0 LEFT JOIN cumb y ON y.ticker_id = r.ticker_id AND y.pos = r.d1) q""",
        ("cumb", "SELECT ticker_id, pos, adj_close, sum(coalesce(mkt, 0)) OVER (PARTITION BY ticker_id ORDER BY trade_date) AS c FROM fx"),
    ),
)
def _(spark, d):
    bars = V.bars(spark, d)
    return rounded(U.filing_reaction(_probes(spark, d), V.filings(spark, d), bars, P.universe_returns(bars)))


_EST = ["rec_mean", "price_target_mean", "eps_mean", "eps_std", "fwd_pe", "fwd_ev_ebitda", "num_analysts", "pt_num_estimates"]
EST = (
    "est",
    "SELECT g.ticker_id, g.date, " + ", ".join(f"e{i}_{k}.{f} AS {f}_{k}" for i, f in enumerate(_EST) for k in (0, 30, 90)) + ", sa.s AS es, sb.s AS rs FROM grid_bars g"
    + "".join(_asof(f"e{i}_{k}", f, f"g.date - {k}", "estimates", "as_of_date") for i, f in enumerate(_EST) for k in (0, 30, 90))
    + "".join(f" ASOF LEFT JOIN (SELECT ticker_id, report_date, ({a} - {c}) / abs({c}) AS s FROM surprises WHERE {a} IS NOT NULL AND {c} <> 0) {n} ON g.ticker_id = {n}.ticker_id AND g.date >= {n}.report_date" for n, a, c in (("sa", "eps_actual", "eps_consensus"), ("sb", "rev_actual", "rev_consensus"))),
)
_chg = lambda f, k: f"coalesce(CASE WHEN {f}_{k} <> 0 THEN ({f}_0 - {f}_{k}) / abs({f}_{k}) END, 0)"


@query(
    "x17_estimate_features",
    oracle(
        "SELECT ticker_id, date, " + ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in {
            "rec_mean_level": "coalesce(rec_mean_0, 0)", "rec_rev_30d": "coalesce(rec_mean_30 - rec_mean_0, 0)", "rec_rev_90d": "coalesce(rec_mean_90 - rec_mean_0, 0)", "price_target_mean": "coalesce(price_target_mean_0, 0)",
            "price_target_rev_90d": _chg("price_target_mean", 90), "forward_earnings_yield": "coalesce(CASE WHEN fwd_pe_0 > 0 THEN 1 / fwd_pe_0 END, 0)", "forward_ebitda_yield": "coalesce(CASE WHEN fwd_ev_ebitda_0 > 0 THEN 1 / fwd_ev_ebitda_0 END, 0)",
            "revenue_surprise": "coalesce(rs, 0)", "eps_surprise": "coalesce(es, 0)", "eps_est_rev_30d": _chg("eps_mean", 30), "eps_est_rev_90d": _chg("eps_mean", 90), "coverage_chg_90d": "coalesce(num_analysts_0 - num_analysts_90, 0)",
            "pt_num_estimates": "coalesce(pt_num_estimates_0, 0)", "eps_dispersion": "coalesce(CASE WHEN abs(eps_mean_0) >= 0.01 THEN eps_std_0 / abs(eps_mean_0) END, 0)"}.items()) + " FROM est",
        EST,
    ),
)
def _(spark, d):
    return rounded(U.estimate_features(_probes(spark, d), V.estimates(spark, d), V.surprises(spark, d)))


@query("x18_surprises", oracle("SELECT ticker_id, date, round(coalesce(es, 0), 6) + 0.0 AS eps_surprise, round(coalesce(rs, 0), 6) + 0.0 AS revenue_surprise FROM est", EST))
def _(spark, d):
    return rounded(U.estimate_features(_probes(spark, d), V.estimates(spark, d), V.surprises(spark, d)).select("ticker_id", "date", "eps_surprise", "revenue_surprise"))


@query("x19_short_ratio", oracle("""SELECT g.ticker_id, g.date, round(coalesce(CASE WHEN s.days_to_cover > 0 THEN s.days_to_cover WHEN s.avg_daily_volume > 0 THEN s.short_interest / s.avg_daily_volume END, 0), 6) AS short_ratio
  FROM grid_bars g ASOF LEFT JOIN short_interest s ON g.ticker_id = s.ticker_id AND g.date >= s.publication_date"""))
def _(spark, d):
    return rounded(U.short_ratio(_probes(spark, d), V.short_interest(spark, d)))


@query("p01_log_ratio", oracle("SELECT ticker_id, trade_date, round(coalesce(ln(adj_close / prev), 0), 6) + 0.0 AS log_ratio FROM px"))
def _(spark, d):
    return rounded(V.bars(spark, d).select("ticker_id", "trade_date", S.log_ratio("adj_close", F.lag("adj_close").over(P.by_ticker())).alias("log_ratio")))


@query("p02_safe_ratio", oracle("SELECT accession_number, round(CASE WHEN abs(total_equity) > 1e-9 THEN net_income / total_equity ELSE 0 END, 6) + 0.0 AS ratio FROM filings"))
def _(spark, d):
    return rounded(V.filings(spark, d).select("accession_number", S.safe_ratio("net_income", "total_equity").alias("ratio")))


@query("p03_months_before", "SELECT l_orderkey, l_linenumber, (l_shipdate::DATE - INTERVAL 6 MONTH)::DATE AS before_6, (l_shipdate::DATE - INTERVAL 18 MONTH)::DATE AS before_18 FROM lineitem")
def _(spark, d):
    day = F.to_date("l_shipdate")
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.months_before(day, 6).alias("before_6"), S.months_before(day, 18).alias("before_18"))


@query("p06_seasonal", oracle("SELECT ticker_id, trade_date, round(sin(dayofyear(trade_date) * (2 * pi() / 365.25)), 6) + 0.0 AS season_sin, round(cos(dayofyear(trade_date) * (2 * pi() / 365.25)), 6) + 0.0 AS season_cos FROM bars"))
def _(spark, d):
    a, b = S.seasonal("trade_date")
    return rounded(V.bars(spark, d).select("ticker_id", "trade_date", a.alias("season_sin"), b.alias("season_cos")))


RANK = "CASE WHEN count({v}) OVER (PARTITION BY {by}) < 2 THEN {one} ELSE {lo} + {width} * (rank() OVER (PARTITION BY {by} ORDER BY {v}) - 1 + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0) / greatest(count({v}) OVER (PARTITION BY {by}) - 1, 1) END"


def sql_rank(v: str, by: str = "date", one="0.5", lo="0.0", width="1.0") -> str:
    return RANK.format(v=v, by=by, one=one, lo=lo, width=width)


@query("w23_rank01", oracle(f"SELECT date, ticker_id, round({sql_rank('q')}, 6) AS pct FROM (SELECT date, ticker_id, round(mom_6m, 1) AS q FROM panel)"))
def _(spark, d):
    p = L.price_panel(spark, d).select("date", "ticker_id", F.round("mom_6m", 1).alias("q"))
    return rounded(X.rank01(p, ["date"], "q", "pct").select("date", "ticker_id", "pct"))


_PRICE = " ".join(L.PACKS["price"])


@query("x05_rank_normalize", oracle("SELECT date, ticker_id, " + ", ".join(f"round({sql_rank(c, one='0.0', lo='-1.0', width='2.0')}, 6) + 0.0 AS {c}" for c in _PRICE.split()) + " FROM (SELECT date, ticker_id, " + ", ".join(f"round({c}, 8) + 0.0 AS {c}" for c in _PRICE.split()) + " FROM panel)"))
def _(spark, d):
    p = rounded(L.price_panel(spark, d).select("date", "ticker_id", *_PRICE.split()), digits=8)
    return rounded(X.rank_normalize(p, _PRICE.split()))


@query("x01_price_panel", oracle(f"SELECT date, ticker_id, sector, {_r(_PRICE)}, {_r('r_1M r_3M r_6M r_1Y')}, mask_1M, mask_3M, mask_6M, mask_1Y FROM panel"))
def _(spark, d):
    return rounded(L.price_panel(spark, d).select("date", "ticker_id", "sector", *_PRICE.split(), "r_1M", "r_3M", "r_6M", "r_1Y", "mask_1M", "mask_3M", "mask_6M", "mask_1Y"))


@query("x02_demean", oracle("SELECT p.date, p.ticker_id, round(CASE WHEN mask_3M AND median IS NOT NULL THEN r_3M - median ELSE 0 END, 6) + 0.0 AS r_3M, mask_3M AND median IS NOT NULL AS mask_3M FROM panel p LEFT JOIN medians m ON p.date = m.trade_date AND m.horizon = '3M'", DATED, MEDIANS))
def _(spark, d):
    m = P.forward_medians(V.bars(spark, d)).filter("horizon = '3M'").withColumnRenamed("trade_date", "date")
    return rounded(X.demean(L.price_panel(spark, d), m, "3M").select("date", "ticker_id", "r_3M", "mask_3M"))


@query("x03_relabel", oracle("SELECT p.date, p.ticker_id, mask_1M AND median IS NOT NULL AND round(r_1M - median, 9) > 0 AS y_1M FROM panel p LEFT JOIN medians m ON p.date = m.trade_date AND m.horizon = '1M'", DATED, MEDIANS))
def _(spark, d):
    m = P.forward_medians(V.bars(spark, d)).filter("horizon = '1M'").withColumnRenamed("trade_date", "date")
    out = X.demean(L.price_panel(spark, d), m, "1M")
    return out.select("date", "ticker_id", (F.col("mask_1M") & (F.round("r_1M", 9) > 0)).alias("y_1M"))


def _gap(v: str, g: str, valid: str = "true") -> str:
    return f"CASE WHEN {g} IS NOT NULL AND count({v}) FILTER ({valid}) OVER (PARTITION BY date, {g}) >= 5 THEN {v} - median({v}) FILTER ({valid}) OVER (PARTITION BY date, {g}) ELSE {v} END"


@query("x04_industry_neutral", oracle(f"SELECT date, ticker_id, round({_gap('mom_12_1', 'sector')}, 6) + 0.0 AS neutral FROM panel"))
def _(spark, d):
    return rounded(X.group_median_gap(L.price_panel(spark, d), "mom_12_1", "sector", "neutral").select("date", "ticker_id", "neutral"))


_KNIFE_Q = ("kq", "SELECT date, ticker_id, sector, r_3M, mask_3M, round(mom_6m, 8) + 0.0 AS mom_6m, round(vol_60d, 8) AS vol_60d, round(vol_120d, 8) AS vol_120d, round(ma_gap_200, 8) + 0.0 AS ma_gap_200, round(dist_low_252, 8) AS dist_low_252, round(efficiency_ratio_120d, 8) AS er, round(mom_1m, 8) + 0.0 AS mom_1m FROM panel")
KNIFE = ("knife", f"SELECT *, v AS vol_p, 1 - (t + l) / 2 AS downtrend_p, v * (1 - (t + l) / 2) AS knife_score FROM (SELECT *, {sql_rank('vol_120d')} AS v, {sql_rank('ma_gap_200')} AS t, {sql_rank('dist_low_252')} AS l FROM kq)")


def knife_panel(spark, d):
    p = L.price_panel(spark, d).withColumnRenamed("efficiency_ratio_120d", "er").select("date", "ticker_id", "sector", "r_3M", "mask_3M", "mom_6m", "vol_60d", "vol_120d", "ma_gap_200", "dist_low_252", "er", "mom_1m")
    return X.knife_score(rounded(p, "r_3M", digits=8))


@query("x06_knife_score", oracle("SELECT date, ticker_id, round(knife_score, 9) AS knife_score FROM knife", _KNIFE_Q, KNIFE))
def _(spark, d):
    return rounded(knife_panel(spark, d).select("date", "ticker_id", "knife_score"), digits=9)


@query("x07_knife_tier", oracle("SELECT date, ticker_id, CASE WHEN round(vol_p, 9) >= 0.8 AND round(downtrend_p, 9) >= 0.8 THEN 'high' WHEN round(vol_p, 9) >= 0.6 AND round(downtrend_p, 9) >= 0.6 THEN 'elevated' ELSE 'none' END AS tier FROM knife", _KNIFE_Q, KNIFE))
def _(spark, d):
    return knife_panel(spark, d).select("date", "ticker_id", X.knife_tier(F.round("vol_p", 9), F.round("downtrend_p", 9)).alias("tier"))


@query("x08_knife_overlay", oracle(f"SELECT date, ticker_id, round({sql_rank('b')}, 6) AS overlay FROM (SELECT date, ticker_id, round(0.8 * r - 0.2 * k, 9) AS b FROM (SELECT date, ticker_id, {sql_rank('mom_6m')} AS r, {sql_rank('ks')} AS k FROM (SELECT *, round(knife_score, 9) AS ks FROM knife)))", _KNIFE_Q, KNIFE))
def _(spark, d):
    p = X.rank01(knife_panel(spark, d).withColumn("ks", F.round("knife_score", 9)), ["date"], "mom_6m", "r")
    p = X.rank01(p, ["date"], "ks", "k").withColumn("b", F.round(0.8 * F.col("r") - 0.2 * F.col("k"), 9))
    return rounded(X.rank01(p, ["date"], "b", "overlay").select("date", "ticker_id", "overlay"))


@query("x09_target_rank", oracle("SELECT date, ticker_id, round(CASE WHEN mask_3M THEN (rank() OVER (PARTITION BY date, mask_3M ORDER BY r_3M) + (count(*) OVER (PARTITION BY date, mask_3M, r_3M) - 1) / 2.0) / count(*) OVER (PARTITION BY date, mask_3M) END, 6) AS y_rank FROM panel"))
def _(spark, d):
    return rounded(X.target_rank(L.price_panel(spark, d), "3M").select("date", "ticker_id", "y_rank"))


@query(
    "x10_target_quantile",
    oracle("""SELECT p.date, p.ticker_id, CASE WHEN mask_3M AND q.n >= 5 THEN greatest(len(list_filter(e, lambda x: x < r_3M)) - 1, 0)::INT END AS y_quantile FROM panel p LEFT JOIN (
  SELECT date, count(*) AS n, list_distinct(quantile_cont(r_3M, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS e FROM panel WHERE mask_3M GROUP BY date) q ON p.date = q.date"""),
)
def _(spark, d):
    return X.target_quantile(L.price_panel(spark, d), "3M").select("date", "ticker_id", "y_quantile")


@query("x11_target_sector_return", oracle(f"SELECT date, ticker_id, round({_gap('r_3M', 'sector', 'mask_3M')}, 6) + 0.0 AS y_sector_return FROM panel"))
def _(spark, d):
    return rounded(X.target_sector_return(L.price_panel(spark, d), "3M").select("date", "ticker_id", "y_sector_return"))


@query("x12_target_sector_return_vol", oracle(f"SELECT p.date, ticker_id, round(s / greatest(vol_120d, f, 1e-4), 5) + 0.0 AS y_sector_return_vol FROM (SELECT *, {_gap('r_3M', 'sector', 'mask_3M')} AS s FROM panel) p JOIN (SELECT date, quantile_cont(vol_120d, 0.2) AS f FROM panel GROUP BY date) q ON p.date = q.date"))
def _(spark, d):
    return rounded(X.target_sector_return_vol(L.price_panel(spark, d), "3M").select("date", "ticker_id", "y_sector_return_vol"), digits=5)


_BETA = ("resid", "SELECT p.date, p.ticker_id, p.sector, CASE WHEN mask_3M THEN r_3M - beta_252d * m.market_r END AS y_beta_resid FROM panel p LEFT JOIN market_r m ON p.date = m.date AND m.horizon = '3M'")


def _market_r(spark, d):
    bars = V.bars(spark, d)
    return P.market_horizon_returns(P.universe_returns(bars), P.month_end_grid(bars))


@query("x13_target_beta_resid", oracle("SELECT date, ticker_id, round(y_beta_resid, 5) + 0.0 AS y_beta_resid FROM resid", CUM, MARKET_R, _BETA))
def _(spark, d):
    return rounded(X.target_beta_resid(L.price_panel(spark, d), _market_r(spark, d), "3M").select("date", "ticker_id", "y_beta_resid"), digits=5)


@query("x14_target_beta_sector_resid", oracle(f"SELECT date, ticker_id, round({_gap('y_beta_resid', 'sector')}, 5) + 0.0 AS y_beta_sector_resid FROM resid", CUM, MARKET_R, _BETA))
def _(spark, d):
    return rounded(X.target_beta_resid(L.price_panel(spark, d), _market_r(spark, d), "3M", True).select("date", "ticker_id", "y_beta_sector_resid"), digits=5)


@query("a19_date_percentile", oracle("SELECT date, round(quantile_cont(vol_60d, 0.2), 6) AS value FROM panel GROUP BY date"))
def _(spark, d):
    return rounded(X.date_percentile(L.price_panel(spark, d), "vol_60d", 0.2))


@query("x15_prepared_panel")
def _(spark, d):
    p = L.prepared_panel(spark, d)
    return p.select("date", "ticker_id", "sector", *L.feature_columns(("valuation", "quality", "residual_momentum", "earnings_reaction", "analyst_revision", "estimate_surprise", "eps_surprise", "revision_momentum", "forward_valuation", "lottery", "microstructure", "knife", "eps_dispersion", "short_interest")), *(f"{k}_{h}" for h in P.HORIZONS for k in ("r", "mask")))


@query("e00_top_momentum", oracle(f"SELECT * FROM (SELECT date, ticker_id, round({sql_rank('mom_1m')}, 6) AS rank FROM panel QUALIFY row_number() OVER (PARTITION BY date ORDER BY mom_1m DESC, ticker_id) <= 20)"))
def top_momentum(spark, d):
    """Flagship: the 20 names of best one-month momentum at each month end."""
    from pyspark.sql import Window

    p = X.rank01(L.price_panel(spark, d).select("date", "ticker_id", "mom_1m"), ["date"], "mom_1m", "rank")
    rn = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("mom_1m"), "ticker_id"))
    return rounded(p.withColumn("rn", rn).filter("rn <= 20").select("date", "ticker_id", "rank"))
