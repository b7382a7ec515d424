"""Per-bar price factors over each ticker's bars: one shuffle and one sort by (ticker_id, trade_date).

Sums, means, variances and covariances over trailing rows come from running sums and their lag, so
their cost doesn't grow with the window; only maxima, minima and the like keep sliding frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartz_panel.functions.scalar import log_ratio

HORIZONS = {"1M": 21, "3M": 63, "6M": 126, "1Y": 252}
def by_ticker():
    """Bars of a ticker in order of their dates."""
    return Window.partitionBy("ticker_id").orderBy("trade_date")


def rows(n: int):
    return by_ticker().rowsBetween(-(n - 1), 0)


def bar_index(bars: DataFrame) -> DataFrame:
    """Adds pos, the place of a bar in its ticker's history (from 0)."""
    return bars.withColumn("pos", F.row_number().over(by_ticker()) - 1)


def with_daily(bars: DataFrame) -> DataFrame:
    """Adds daily, the log return from the bar before; null where a price is null, NaN or not positive.  A NaN price becomes null."""
    bars = bars.withColumn("adj_close", F.when(~F.isnan("adj_close"), F.col("adj_close")))
    prev = F.lag("adj_close").over(by_ticker())
    return bars.withColumn("daily", F.when((F.col("adj_close") > 0) & (prev > 0), F.ln(F.col("adj_close") / prev)))


def universe_returns(bars: DataFrame) -> DataFrame:
    """trade_date, mkt: equal-weight mean of the daily log returns."""
    return with_daily(bars).filter("daily is not null").groupBy("trade_date").agg(F.avg("daily").alias("mkt"))


def rolling_sums(df: DataFrame, sums: dict[str, Column], wanted: list[tuple[str, int, int]]) -> DataFrame:
    """Adds {name}_{n}_{skip}: the sum of an expression over the n rows that end skip rows before the current one.

    Nulls count as 0.  One running sum for each expression, then a difference for each frame."""
    run = by_ticker().rowsBetween(Window.unboundedPreceding, 0)
    df = df.select("*", *(F.sum(F.coalesce(e.cast("double"), F.lit(0.0))).over(run).alias(f"__{k}") for k, e in sums.items()))
    at = lambda k, n: F.coalesce(F.lag(f"__{k}", n).over(by_ticker()), F.lit(0.0)) if n else F.col(f"__{k}")
    df = df.select("*", *((at(k, skip) - at(k, skip + n)).alias(f"{k}_{n}_{skip}") for k, n, skip in wanted))
    return df.drop(*(f"__{k}" for k in sums))


def rolling_extremes(df: DataFrame, wanted: dict[str, tuple[Column, int, bool]]) -> DataFrame:
    """Adds each name's extreme of an expression over the last n rows (True: the largest, else the smallest); nulls are skipped.

    Extremes of 6, 36, ... rows are made of lagged smaller ones, so a row costs a few lags, not n."""
    df = df.select("*", *(e.alias(name) for name, (e, _, _) in wanted.items()))
    span = dict.fromkeys(wanted, 1)
    while any(span[k] < n for k, (_, n, _) in wanted.items()):
        wider = {}
        for k, (_, n, largest) in wanted.items():
            s = span[k]
            if s < n:
                steps = range(s, 6 * s, s) if 7 * s < n else sorted({*range(s, n - s + 1, s), n - s})
                wider[k] = (F.greatest if largest else F.least)(F.col(k), *(F.lag(k, i).over(by_ticker()) for i in steps)) if steps else F.col(k)
                span[k] = 6 * s if 7 * s < n else n
        df = df.select(*(wider[c].alias(c) if c in wider else c for c in df.columns))
    return df


def price_factors(bars: DataFrame, tickers: DataFrame, market: DataFrame | None = None, min_pos: int = 252) -> DataFrame:
    """All price factors of each bar with ``min_pos`` bars before it; nulls follow each factor's rule (gaps are 0)."""
    market = market if market is not None else universe_returns(bars)
    df = with_daily(bar_index(bars)).join(F.broadcast(market), "trade_date", "left").join(F.broadcast(tickers.select("ticker_id", "shares_outstanding", "sector", "industry")), "ticker_id")
    c, d, m = F.col, F.col("daily"), F.col("mkt")
    s = F.when(m.isNotNull(), F.coalesce(d, F.lit(0.0)))
    dv = c("adj_close") * c("volume")
    df = rolling_sums(
        df,
        {
            "n": m.isNotNull(), "x": s, "y": m, "xx": s * s, "yy": m * m, "xy": s * m,
            "k": d.isNotNull(), "d": d, "dd": d * d, "ddd": d * d * d, "ad": F.abs(d), "neg": F.when(d < 0, d * d),
            "p": c("adj_close"), "pn": c("adj_close").isNotNull(), "v": c("volume"), "il": F.when((dv > 0) & d.isNotNull(), F.abs(d) / dv), "iln": (dv > 0) & d.isNotNull(),
        },
        [*((k, 251, 0) for k in ("n", "x", "y", "xx", "yy", "xy")), *((k, w, 0) for k in ("k", "d", "dd") for w in (20, 60, 120)), *((k, 120, 0) for k in ("ddd", "ad", "neg", "v")),
         ("p", 50, 0), ("p", 200, 0), ("pn", 50, 0), ("pn", 200, 0), ("v", 20, 0), ("v", 60, 0), ("il", 60, 0), ("iln", 60, 0), ("y", 231, 21), ("y", 126, 0)],
    )
    price = F.when(c("adj_close") > 0, c("adj_close"))
    df = rolling_extremes(df, {"__max_ret": (d, 21, True), "__high": (price, 252, True), "__low": (price, 252, False)})
    lag = lambda n: F.lag("adj_close", n).over(by_ticker())
    up = [F.when(lag(21 * (i - 1)) > 0, F.when(lag(21 * i) > 0, F.when(lag(21 * (i - 1)) > lag(21 * i), 1.0).otherwise(0.0))) if i > 1 else F.when((c("adj_close") > 0) & (lag(21) > 0), F.when(c("adj_close") > lag(21), 1.0).otherwise(0.0)) for i in range(1, 7)]
    n_up = sum((u.isNotNull().cast("double") for u in up), F.lit(0.0))
    df = df.select(
        "*",
        log_ratio("adj_close", lag(21)).alias("mom_1m"),
        log_ratio("adj_close", lag(63)).alias("mom_3m"),
        log_ratio("adj_close", lag(126)).alias("mom_6m"),
        log_ratio(lag(21), lag(252)).alias("mom_12_1"),
        F.coalesce(sum((F.coalesce(u, F.lit(0.0)) for u in up), F.lit(0.0)) / F.nullif(n_up, F.lit(0.0)), F.lit(0.0)).alias("mom_consistency_6m"),
    ).filter(c("pos") >= min_pos)
    zero = lambda x: F.coalesce(x, F.lit(0.0))

    def deviation(w: int) -> Column:
        n, a, b = c(f"k_{w}_0"), c(f"d_{w}_0"), c(f"dd_{w}_0")
        return zero(F.when(n > 1, F.sqrt(F.greatest(b / n - (a / n) * (a / n), F.lit(0.0)))))

    n = c("n_251_0")
    full = n >= 60
    var_x = F.when(full, c("xx_251_0") / n - (c("x_251_0") / n) * (c("x_251_0") / n))
    var_y = F.when(full, c("yy_251_0") / n - (c("y_251_0") / n) * (c("y_251_0") / n))
    cov = F.when(full, c("xy_251_0") / n - (c("x_251_0") / n) * (c("y_251_0") / n))
    df = df.select("*", *(deviation(w).alias(f"vol_{w}d") for w in (20, 60, 120)), var_x.alias("__vx"), var_y.alias("__vy"), cov.alias("__cov"))
    df = df.withColumn("beta_252d", zero(F.when(c("__vy") > 1e-12, c("__cov") / c("__vy"))))
    n, sd, mean = c("k_120_0"), c("vol_120d"), c("d_120_0") / c("k_120_0")
    some = (n >= 20) & (sd > 1e-12)
    third = c("ddd_120_0") / n - 3 * mean * c("dd_120_0") / n + 2 * mean * mean * mean
    return df.select(
        "ticker_id", "trade_date", "pos", "adj_close", "volume", "sector", "industry", "shares_outstanding",
        "mom_1m", "mom_3m", "mom_6m", "mom_12_1", "beta_252d", "vol_20d", "vol_60d", "vol_120d",
        zero(F.when((c("adj_close") > 0) & (c("shares_outstanding") > 0), F.ln(c("adj_close") * c("shares_outstanding")))).alias("log_market_cap"),
        zero(F.expm1("__max_ret")).alias("max_ret_21d"),
        F.when(full, F.sqrt(F.greatest(c("__vx") - 2 * c("beta_252d") * c("__cov") + c("beta_252d") * c("beta_252d") * c("__vy"), F.lit(0.0)))).otherwise(c("vol_120d")).alias("idio_vol"),
        log_ratio("adj_close", "__high").alias("dist_high_252"),
        log_ratio("adj_close", "__low").alias("dist_low_252"),
        log_ratio("adj_close", c("p_50_0") / F.nullif(c("pn_50_0"), F.lit(0.0))).alias("ma_gap_50"),
        log_ratio("adj_close", c("p_200_0") / F.nullif(c("pn_200_0"), F.lit(0.0))).alias("ma_gap_200"),
        log_ratio(c("v_20_0") / 20, c("v_120_0") / 120).alias("vol_trend"),
        zero(F.when(some, third / (sd * sd * sd))).alias("ret_skew_120d"),
        zero(F.when(some, F.sqrt(F.greatest(c("neg_120_0"), F.lit(0.0)) / n) / sd)).alias("downside_vol_ratio_120d"),
        zero(F.when((n >= 20) & (c("ad_120_0") > 1e-12), F.abs(c("d_120_0")) / c("ad_120_0"))).alias("efficiency_ratio_120d"),
        zero(F.when(c("iln_60_0") > 0, c("il_60_0") / c("iln_60_0") * 1e6)).alias("amihud_illiq_60d"),
        zero(c("v_60_0") / 60 / c("shares_outstanding")).alias("turnover_60d"),
        (c("mom_12_1") - c("beta_252d") * c("y_231_21")).alias("resid_mom_12_1"),
        (c("mom_6m") - c("beta_252d") * c("y_126_0")).alias("resid_mom_6m"),
        (c("mom_3m") - c("mom_6m")).alias("mom_accel_3_6"),
        "mom_consistency_6m",
    )


def forward_targets(bars: DataFrame) -> DataFrame:
    """Adds r_h (forward log return over h's bars, 0 where masked), up_h and mask_h for each horizon."""
    out = []
    for name, n in HORIZONS.items():
        later = F.lead("adj_close", n).over(by_ticker())
        ok = F.coalesce((F.col("adj_close") > 0) & (later > 0), F.lit(False))
        r = log_ratio(later, "adj_close")
        out += [F.when(ok, r).otherwise(0.0).alias(f"r_{name}"), (ok & (r > 0)).alias(f"up_{name}"), ok.alias(f"mask_{name}")]
    return bars.select("*", *out)


def month_end_grid(bars: DataFrame) -> DataFrame:
    """date: the last traded date of each month over all tickers."""
    return bars.groupBy(F.trunc("trade_date", "month").alias("m")).agg(F.max("trade_date").alias("date")).select("date")


def _numbered_dates(bars: DataFrame) -> DataFrame:
    """Distinct dates and their number: a calendar, so one small window without a partition is in order."""
    return bars.select("trade_date").distinct().withColumn("idx", F.row_number().over(Window.orderBy("trade_date")))


def market_horizon_returns(market: DataFrame, grid: DataFrame) -> DataFrame:
    """date, horizon, market_r: sum of market returns over the horizon's dates from the first date at or after the grid date."""
    w = Window.orderBy("trade_date")
    idx = market.withColumn("idx", F.row_number().over(w) - 1).withColumn("before", F.sum("mkt").over(w) - F.col("mkt"))
    ends = idx.select(F.col("idx").alias("end_idx"), F.col("before").alias("upto")).unionByName(idx.agg((F.max("idx") + 1).alias("end_idx"), F.sum("mkt").alias("upto")))
    first = grid.join(idx, idx.trade_date >= grid.date).groupBy("date").agg(F.min(F.struct("idx", "before")).alias("f")).select("date", "f.*")
    hs = first.select("*", F.explode(F.create_map(*(x for k, n in HORIZONS.items() for x in (F.lit(k), F.lit(n))))).alias("horizon", "n"))
    return hs.join(F.broadcast(ends), F.col("idx") + F.col("n") == F.col("end_idx")).select("date", "horizon", (F.col("upto") - F.col("before")).alias("market_r"))


def forward_medians(bars: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """trade_date, horizon, median: forward return on the union calendar (rows of the date x ticker matrix), median over tickers.

    ``dates`` (date): medians of these dates alone.  The later price is the row that stands n dates on in the name's own window, so bars aren't joined to themselves."""
    dated = bars.join(F.broadcast(_numbered_dates(bars)), "trade_date").select("ticker_id", "trade_date", "idx", "adj_close")
    at = lambda n: F.first("adj_close").over(Window.partitionBy("ticker_id").orderBy("idx").rangeBetween(n, n))
    both = dated.select("trade_date", "adj_close", *(at(n).alias(f"__{h}") for h, n in HORIZONS.items()))
    if dates is not None:
        both = both.join(F.broadcast(dates.select(F.col("date").alias("trade_date")).distinct()), "trade_date", "left_semi")
    both = both.select("trade_date", "adj_close", F.explode(F.create_map(*(x for h in HORIZONS for x in (F.lit(h), F.col(f"__{h}"))))).alias("horizon", "later")).filter("adj_close > 0 and later > 0")
    return both.groupBy("trade_date", "horizon").agg(F.median(F.ln(F.col("later") / F.col("adj_close"))).alias("median"))


def grid_medians(bars: DataFrame, calendar: list) -> DataFrame:
    """trade_date, horizon, median of ``forward_medians`` for the last date of each month of ``calendar`` (all trade dates).

    Only bars of these dates and of those a horizon later are read, and meet by name and date."""
    days = sorted({x for x in calendar if x is not None})
    place = {x: i for i, x in enumerate(days)}
    grid = sorted({(x.year, x.month): x for x in days}.values())
    wanted = [(days[place[g] + n], g, h) for g in grid for h, n in {"own": 0, **HORIZONS}.items() if place[g] + n < len(days)]
    spark = bars.sparkSession
    marks = spark.createDataFrame(wanted, "trade_date date, date date, horizon string")
    some = bars.filter(F.col("trade_date").isin(sorted({x for x, _, _ in wanted}))).join(F.broadcast(marks), "trade_date")
    at = lambda k: F.max(F.when(F.col("horizon") == k, F.col("adj_close"))).alias(f"__{k}")
    both = some.groupBy("ticker_id", "date").agg(at("own"), *map(at, HORIZONS)).filter("__own > 0")
    both = both.select("date", "__own", F.explode(F.create_map(*(x for h in HORIZONS for x in (F.lit(h), F.col(f"__{h}"))))).alias("horizon", "later")).filter("later > 0")
    return both.groupBy(F.col("date").alias("trade_date"), "horizon").agg(F.median(F.ln(F.col("later") / F.col("__own"))).alias("median"))


def trailing_sharpe(bars: DataFrame, as_of=None, window: int = 252, days: int = 420, min_obs: int = 30) -> DataFrame:
    """ticker_id, sharpe: annualised mean over sample deviation of the last ``window`` bars within ``days`` of ``as_of`` (default: the last bar)."""
    limit = bars.agg(F.max("trade_date").alias("as_of")) if as_of is None else bars.sparkSession.createDataFrame([(as_of,)], "as_of date")
    recent = bars.crossJoin(F.broadcast(limit)).filter("trade_date <= as_of and trade_date >= date_sub(as_of, {})".format(days))
    last = recent.withColumn("rn", F.row_number().over(Window.partitionBy("ticker_id").orderBy(F.desc("trade_date")))).filter(F.col("rn") <= window)
    ret = last.withColumn("prev", F.lag("adj_close").over(by_ticker())).filter("prev > 0").withColumn("r", F.col("adj_close") / F.col("prev") - 1)
    out = ret.groupBy("ticker_id").agg(F.count("r").alias("n"), F.avg("r").alias("a"), F.stddev_samp("r").alias("s"))
    return out.select("ticker_id", F.when((F.col("n") >= min_obs) & (F.col("s") > 0), F.col("a") / F.col("s") * F.sqrt(F.lit(252.0))).alias("sharpe"))
