"""The month-end panel: grid x tickers with price factors, fundamentals, analyst figures, sentiment and targets."""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartz_panel.operators import crosssection as X
from quartz_panel.operators import fundamentals as U
from quartz_panel.operators import price as P
from quartz_panel.operators import sentiment as T
from quartz_panel.operators.asof import asof_join
from quartz_panel.operators.cut import cut
from quartz_panel.operators.month_rows import BLOCK, month_rows
from quartz_panel.sources import views as V

#: Feature names by pack.
PACKS = {
    "price": ("mom_1m", "mom_3m", "mom_6m", "mom_12_1", "log_market_cap", "vol_20d", "vol_60d", "vol_120d", "dist_high_252", "dist_low_252", "ma_gap_50", "ma_gap_200", "vol_trend"),
    "fundamental": ("revenue_growth", "gross_margin", "operating_margin", "debt_equity", "fcf_revenue"),
    "available": ("fund_available",),
    "sentiment": ("sentiment_7d", "sentiment_14d"),
    "valuation": ("earnings_yield", "book_to_market", "sales_to_price", "fcf_yield"),
    "quality": ("roe_ttm", "net_margin_ttm", "fcf_margin_ttm", "gross_margin_stability_4q", "operating_margin_stability_4q", "revenue_growth_stability_4q"),
    "residual_momentum": ("resid_mom_12_1", "resid_mom_6m", "mom_accel_3_6", "mom_consistency_6m", "industry_neutral_mom_12_1"),
    "earnings_reaction": ("filing_drift_30d", "filing_surprise_3d", "filings_recency_days", "filings_in_90d"),
    "analyst_revision": ("rec_mean_level", "rec_rev_30d", "rec_rev_90d", "price_target_rev_90d"),
    "estimate_surprise": ("revenue_surprise",),
    "eps_surprise": ("eps_surprise",),
    "forward_valuation": ("forward_earnings_yield", "forward_ebitda_yield", "price_target_upside"),
    "revision_momentum": ("eps_est_rev_30d", "eps_est_rev_90d", "coverage_chg_90d", "pt_num_estimates"),
    "lottery": ("max_ret_21d", "idio_vol"),
    "microstructure": ("ret_skew_120d", "downside_vol_ratio_120d", "amihud_illiq_60d", "turnover_60d", "efficiency_ratio_120d"),
    "knife": ("knife_score",),
    "eps_dispersion": ("eps_dispersion",),
    "short_interest": ("short_ratio",),
}
#: Packs whose features may be ranked within sector and industry.
RELATIVE_PACKS = ("price", "fundamental", "valuation", "quality")
DEFAULT_PACKS = ("price", "fundamental", "available", "sentiment")
#: The production choice of target and settings by horizon.
HORIZON_SPECS = {
    "1M": {"target": "rank", "packs": (), "span": 0, "knife_lambda": 0.0, "window": None},
    "3M": {"target": "sector_return", "packs": ("revision_momentum",), "span": 3, "knife_lambda": 0.2, "window": None},
    "6M": {"target": "sector_return", "packs": (), "extra": ("revenue_surprise",), "span": 0, "knife_lambda": 0.0, "window": 60},
    "1Y": {"target": "sector_return", "packs": (), "extra": ("revenue_surprise",), "span": 4, "knife_lambda": 0.0, "window": None},
}


def feature_columns(packs=(), extra=(), base=DEFAULT_PACKS) -> list[str]:
    """Features of the base packs, then of ``packs`` and ``extra``; doubles dropped, order kept."""
    return list(dict.fromkeys([*(c for p in (*base, *packs) for c in PACKS[p]), *extra]))


def grid_bars(bars: DataFrame, max_stale_days: int = 7, min_pos: int = 252) -> DataFrame:
    """date, ticker_id and the last bar at or before each month end, at most so many days old and with enough history."""
    grid, names = P.month_end_grid(bars), bars.select("ticker_id").distinct()
    numbered = P.forward_targets(P.bar_index(bars))
    r = [f"{k}_{h}" for h in P.HORIZONS for k in ("r", "mask")]
    j = asof_join(names.crossJoin(F.broadcast(grid)), numbered.withColumn("bar_date", F.col("trade_date")), ["ticker_id"], "date", "trade_date", ["bar_date", "pos", "adj_close", *r], tolerance_days=max_stale_days)
    return j.filter(F.col("pos") >= min_pos)


def _month_rows(spark, d, sides=None) -> DataFrame:
    grid = [r.date for r in P.month_end_grid(V.days(spark, d)).collect()]  # a date for each month of the calendar
    return month_rows(V.bars(spark, d, BLOCK), V.tickers(spark, d), P.universe_returns(V.bars(spark, d)), grid, sides)


def price_panel(spark, d) -> DataFrame:
    """Grid rows with price factors and forward returns."""
    return _month_rows(spark, d)


def full_panel(spark, d) -> DataFrame:
    """price_panel with fundamentals, valuation, filing reaction, analyst figures, short interest and sentiment; rows are a table, shuffled by name alone."""
    sides = {
        "filings": U.annotated(V.filings(spark, d)),
        "estimates": V.estimates(spark, d),
        "surprises": V.surprises(spark, d),
        "short_interest": V.short_interest(spark, d),
        "sentiment": T.rolling_sentiment(T.sentiment_daily(V.headlines(spark, d))),
    }
    panel = cut(_month_rows(spark, d, sides))
    whole = U.valuation(X.group_median_gap(panel, "mom_12_1", "industry", "industry_neutral_mom_12_1", by_join=True))
    upside = F.when((F.col("adj_close") > 0) & (F.col("price_target_mean") != 0), (F.col("price_target_mean") - F.col("adj_close")) / F.col("adj_close"))
    return whole.withColumn("price_target_upside", F.coalesce(upside, F.lit(0.0)))


def all_features() -> list[str]:
    """Every feature that is ranked: all packs but the knife score, which is made of ranks."""
    return [c for p in PACKS if p != "knife" for c in PACKS[p]]


def prepared_panel(spark, d, horizons=("1M", "3M", "6M", "1Y"), industry_relative: bool = False, targets: Mapping[str, str] | None = None) -> DataFrame:
    """The panel ready to fit: demeaned returns, ranked features, knife score; ``targets``: labels as ``prepared`` makes them."""
    return prepared(full_panel(spark, d), panel_medians(spark, d), horizons, industry_relative, targets)


def panel_medians(spark, d) -> DataFrame:
    """The medians of the panel's dates: a row for each date and horizon."""
    return P.grid_medians(V.bars(spark, d), [r.trade_date for r in V.days(spark, d).collect()])  # the calendar


def prepared(panel: DataFrame, medians: DataFrame, horizons=("1M", "3M", "6M", "1Y"), industry_relative: bool = False, targets: Mapping[str, str] | None = None, digits: int | None = None) -> DataFrame:
    """``panel`` with returns less their date's median (trade_date, horizon, median), features ranked to [-1, 1], raw vol_120d kept, knife score added.

    ``industry_relative``: features of RELATIVE_PACKS are ranked anew within their sector, then within their industry, where the group has five names or more.
    ``targets`` (rank or sector_return by horizon): also label_h, of returns rounded to ``digits`` if given.  All of it is made by date in one shuffle.
    The rows are a table, so the result is cheap to read again."""
    told = {(r.trade_date, r.horizon): r.median for r in medians.collect()}  # a number for each date of the calendar and horizon
    groups = ("sector", "industry") if industry_relative else ()
    added = ", ".join([*(f"y_{h} boolean" for h in horizons), "vol_p double, downtrend_p double, knife_score double", *(f"label_{h} double" for h in targets or {})])
    then = partial(X.date_columns, medians=told, horizons=tuple(horizons), targets=dict(targets or {}), digits=digits)
    return cut(X.rank_normalize(panel.withColumn("vol_120d_raw", F.col("vol_120d")), all_features(), groups, relative_columns=tuple(feature_columns(base=RELATIVE_PACKS)), then=(then, added)))


def targeted(panel: DataFrame, horizon: str, mode: str, out: str = "y") -> DataFrame:
    """``out``: the label of a horizon, null where it has none; that of ``prepared`` if it is there.  Modes: return, rank, quantile, sector_return, sector_return_vol."""
    if f"label_{horizon}" in panel.columns:
        return panel.withColumn(out, F.col(f"label_{horizon}"))
    valid = F.when(F.col(f"mask_{horizon}"), F.col(f"r_{horizon}"))
    if mode == "return":
        return panel.withColumn(out, valid)
    if mode in ("rank", "quantile"):
        made = (X.target_rank if mode == "rank" else X.target_quantile)(panel, horizon)
        return made.withColumn(out, F.col(f"y_{mode}").cast("double")).drop(f"y_{mode}")
    if mode == "sector_return":
        made = X.target_sector_return(panel, horizon, "__y")
    elif mode == "sector_return_vol":
        made = X.target_sector_return_vol(panel, horizon, "vol_120d_raw").withColumnRenamed("y_sector_return_vol", "__y")
    else:
        raise ValueError(mode)
    return made.withColumn(out, F.when(F.col(f"mask_{horizon}"), F.col("__y"))).drop("__y")
