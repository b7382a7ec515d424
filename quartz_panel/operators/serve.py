"""Read queries: rankings, detail bundle, portfolio, screener, quotes, data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import sector_ranks
from .price import trailing_sharpe

#: Days of a lookback token; other tokens mean 366, "max" no bound.
LOOKBACK_DAYS = {"1m": 31, "3m": 93, "6m": 186, "1y": 366, "2y": 731, "5y": 1827}
HORIZON_ORDER = ["1M", "3M", "6M", "1Y"]


def active_model(models: DataFrame) -> DataFrame:
    """The production model promoted last (unpromoted ones after), or else the newest created."""
    return models.orderBy(F.when(F.col("status") == "production", 0).otherwise(1), F.desc_nulls_last("promoted_at"), F.desc("created_at"), "model_id").limit(1)


def rankings(predictions: DataFrame, tickers: DataFrame, bars: DataFrame, models: DataFrame, horizon: str = "6M", limit: int = 500) -> DataFrame:
    """The active model's latest ranking of a horizon (an unknown one means 6M) with sector ranks (after the limit) and trailing Sharpe."""
    horizon = horizon if horizon in HORIZON_ORDER else "6M"
    p = predictions.join(F.broadcast(active_model(models).select("model_id")), "model_id", "left_semi").filter(F.col("horizon") == horizon)
    p = p.join(F.broadcast(p.agg(F.max("as_of_date").alias("as_of_date"))), "as_of_date")
    top = p.join(F.broadcast(tickers.filter("not user_added")), "ticker_id").orderBy(F.desc("score"), "ticker_id").limit(max(1, min(limit, 1000)))
    return sector_ranks(top).join(trailing_sharpe(bars), "ticker_id", "left").select("ticker_id", "symbol", "sector", "as_of_date", "score", "sector_pct", "sector_label", "sharpe")


def latest(df: DataFrame, key: str, ts: str, columns: list[str]) -> DataFrame:
    """The columns of each key's last row: one aggregation, no sort."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), ts).alias("x")).select(key, *(F.col("x")[c].alias(c) for c in columns))


def by_symbol(asked: DataFrame, tickers: DataFrame, symbol: str) -> DataFrame:
    """Rows of ``asked`` with the ticker whose symbol equals the column ``symbol`` in any case; unknown and null symbols give none.

    A column of ``asked`` that tickers have too keeps the ticker's value."""
    own = [c for c in asked.columns if c not in tickers.columns or c == symbol]
    keyed = asked.select(*(F.col(f"`{c}`").alias(f"__{c}") for c in own), F.upper(F.col(f"`{symbol}`")).alias("__key"))
    found = keyed.join(tickers.withColumn("__key", F.upper("symbol")), "__key").drop("__key")
    return found.select(*(F.col(f"`__{c}`").alias(c) for c in own if c not in tickers.columns), *tickers.columns)


def spliced(rows: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with those of every key in ``fresh`` replaced by the fresh ones, which need not be as many; rows of a null key stay."""
    return rows.join(fresh.select(*keys).distinct(), keys, "left_anti").select(*rows.columns).unionByName(fresh.select(*rows.columns))


def active_only(rows: DataFrame, tickers: DataFrame) -> DataFrame:
    """Rows of active tickers that no user added: what models train on and rankings show."""
    return rows.join(tickers.filter("active and not coalesce(user_added, false)").select("ticker_id").distinct(), "ticker_id", "left_semi")


def ticker_detail(tickers: DataFrame, predictions: DataFrame, filings: DataFrame, daily: DataFrame, bars: DataFrame) -> DataFrame:
    """One row for each ticker: scores by horizon in fixed order, latest filing, sentiment and close."""
    place = F.array_position(F.array(*map(F.lit, HORIZON_ORDER)), F.col("horizon"))
    last = predictions.groupBy("ticker_id", "horizon").agg(F.max_by("score", "as_of_date").alias("score"))
    scores = last.groupBy("ticker_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("k"), F.col("horizon"), F.col("score")))), lambda x: F.concat_ws("=", x["horizon"], F.format_number(x["score"], 4))).alias("scores"))
    out = tickers.join(scores, "ticker_id", "left").join(latest(filings, "ticker_id", "filed_at", ["accession_number", "revenue"]), "ticker_id", "left")
    out = out.join(latest(daily, "ticker_id", "score_date", ["mean_score"]), "ticker_id", "left").join(latest(bars, "ticker_id", "trade_date", ["adj_close", "trade_date"]), "ticker_id", "left")
    return out


def adjusted_prices(bars: DataFrame, lookback: str = "1y") -> DataFrame:
    """OHLC scaled by adj_close / close within the lookback before the last bar."""
    k = F.col("adj_close") / F.nullif(F.col("close"), F.lit(0.0))
    df = bars.select("ticker_id", "trade_date", *((F.col(c) * k).alias(c) for c in ("open", "high", "low")), F.col("adj_close").alias("close"), "volume")
    if lookback == "max":
        return df
    return df.join(F.broadcast(bars.agg(F.max("trade_date").alias("__last")))).filter(F.col("trade_date") >= F.date_sub("__last", LOOKBACK_DAYS.get(lookback, 366))).drop("__last")


def search_tickers(tickers: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Active tickers whose symbol or name contains the text in any case; the exact symbol first."""
    q = F.lower(F.lit(text))
    hit = F.lower("symbol").contains(q) | F.lower("name").contains(q)
    return tickers.filter(F.col("active") & hit).orderBy(F.desc(F.lower("symbol") == q), "symbol").limit(limit)


def screener(ranked: DataFrame, text: str | None = None, sectors: list[str] | None = None, min_sharpe: float | None = None, held: DataFrame | None = None, lens: str = "universe") -> DataFrame:
    """Filtered rankings, by universe or within-sector rank, nulls last; a null Sharpe fails a minimum."""
    df = ranked
    if text:
        df = df.filter(F.lower("symbol").contains(text.lower()))
    if sectors:
        df = df.filter(F.col("sector").isin(sectors))
    if min_sharpe is not None:
        df = df.filter(F.coalesce(F.col("sharpe") >= min_sharpe, F.lit(False)))
    if held is not None:
        df = df.join(held.select("ticker_id"), "ticker_id", "left_semi")
    return df.orderBy(F.desc_nulls_last("score" if lens == "universe" else "sector_pct"), "ticker_id")


def rank_tone(x) -> Column:
    return F.when(F.col(x) >= 0.66, "good").when(F.col(x) <= 0.34, "bad").when(F.col(x).isNotNull(), "neutral")


def stability_label(x) -> Column:
    return F.when(F.col(x) < 0.05, "steady").when(F.col(x) < 0.12, "moderate").when(F.col(x).isNotNull(), "shifting")


def sentiment_tone(x) -> Column:
    return F.when(F.col(x) > 0.05, "positive").when(F.col(x) < -0.05, "negative").when(F.col(x).isNotNull(), "neutral")


def with_fallback(filing: DataFrame, vendor: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """All columns from the filing where there is one, else all from the vendor's snapshot."""
    f = filing.select(key, F.struct(*columns).alias("__f"))
    v = vendor.select(key, F.struct(*columns).alias("__v"))
    j = f.join(v, key, "full").withColumn("__x", F.coalesce("__f", "__v"))
    return j.select(key, *(F.col("__x")[c].alias(c) for c in columns), F.when(F.col("__f").isNotNull(), "filing").otherwise("vendor").alias("origin"))


def sparkline(bars: DataFrame, n: int = 30) -> DataFrame:
    """Last ``n`` closes of each ticker scaled to [0, 1] (0.5 when flat), and whether the last is at least the first."""
    w = Window.partitionBy("ticker_id")
    last = bars.withColumn("rn", F.row_number().over(w.orderBy(F.desc("trade_date")))).filter(F.col("rn") <= n)
    lo, hi = F.min("adj_close").over(w), F.max("adj_close").over(w)
    first, end = F.max_by("adj_close", "rn").over(w), F.min_by("adj_close", "rn").over(w)
    return last.select("ticker_id", "trade_date", F.when(hi > lo, (F.col("adj_close") - lo) / (hi - lo)).otherwise(0.5).alias("y"), (end >= first).alias("up"))


def portfolio(holdings: DataFrame, tickers: DataFrame, bars: DataFrame, user_id: int) -> DataFrame:
    """One user's holdings by symbol with the last close."""
    last = latest(bars, "ticker_id", "trade_date", ["adj_close", "trade_date"])
    return holdings.filter(F.col("user_id") == user_id).join(F.broadcast(tickers.select("ticker_id", "symbol", "sector")), "ticker_id").join(last, "ticker_id", "left").orderBy("symbol")


def apply_holding_changes(holdings: DataFrame, changes: DataFrame) -> DataFrame:
    """holdings with changes (user_id, ticker_id, shares, cost_basis, op): put replaces, patch sets what isn't null, delete removes."""
    c = changes.select("user_id", "ticker_id", F.col("shares").alias("__s"), F.col("cost_basis").alias("__c"), "op")
    j = holdings.join(c, ["user_id", "ticker_id"], "full").filter("op is null or op <> 'delete'").filter("op is null or op = 'put' or shares is not null")
    pick = lambda own, new: F.when(F.col("op") == "put", F.col(new)).otherwise(F.coalesce(new, own)).alias(own)
    return j.select("user_id", "ticker_id", pick("shares", "__s"), pick("cost_basis", "__c"))


def quotes_with_fallback(live: DataFrame, bars: DataFrame) -> DataFrame:
    """Price, previous close, change and its share by ticker: the live quote, or else the last stored close, stale and unchanged."""
    j = latest(bars, "ticker_id", "trade_date", ["adj_close"]).join(live.select("ticker_id", F.col("price").alias("live"), F.col("prev_close").alias("live_prev")), "ticker_id", "full")
    stale = F.col("live").isNull()
    price = F.coalesce("live", "adj_close")
    prev = F.when(stale, F.col("adj_close")).otherwise(F.col("live_prev"))
    change = F.when((prev != 0), price - prev)
    return j.select("ticker_id", price.alias("price"), prev.alias("prev_close"), stale.alias("stale"), change.alias("change"), (change / F.nullif(prev, F.lit(0.0))).alias("change_pct"))


def portfolio_value(holdings: DataFrame, quotes: DataFrame) -> DataFrame:
    """By user: value, day change and its share of the value before, return over the cost of holdings that have one, and whether some lack a cost."""
    j = holdings.join(quotes, "ticker_id")
    v = F.col("shares") * F.col("price")
    has = F.col("cost_basis").isNotNull()
    cost = F.sum(F.when(has, F.col("shares") * F.col("cost_basis")))
    day = F.sum(F.col("shares") * F.coalesce("change", F.lit(0.0)))
    out = j.groupBy("user_id").agg(F.sum(v).alias("value"), day.alias("day_change"), cost.alias("cost"), F.sum(F.when(has, v)).alias("covered"), (F.count("cost_basis") < F.count("*")).alias("partial"))
    return out.select("user_id", "value", "day_change", F.try_divide("day_change", F.nullif(F.col("value") - F.col("day_change"), F.lit(0.0))).alias("day_pct"), F.try_divide(F.col("covered") - F.col("cost"), F.nullif(F.col("cost"), F.lit(0.0))).alias("return_pct"), "partial")


def filing_coverage(filings: DataFrame, tickers: DataFrame) -> DataFrame:
    f = filings.groupBy("ticker_id").agg(F.count_if(F.col("filing_type") == "10-K").alias("annual"), F.count_if(F.col("filing_type") == "10-Q").alias("quarterly"), F.min("filed_at").alias("first_filed"), F.max("filed_at").alias("last_filed"))
    return tickers.select("ticker_id", "symbol").join(f, "ticker_id", "left").fillna(0, ["annual", "quarterly"])


def lookahead_leaks(filings: DataFrame) -> DataFrame:
    return filings.agg(F.count_if(F.col("filed_at") < F.col("period_end")).alias("leaks"))


def bar_coverage(bars: DataFrame) -> DataFrame:
    """By ticker: bars, first and last day, bars missing of the trading days in between (0 at least)."""
    b = bars.groupBy("ticker_id").agg(F.count("*").alias("bars"), F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"))
    cal = bars.select("trade_date").distinct().withColumn("i", F.row_number().over(Window.orderBy("trade_date")))
    lo, hi = (cal.select(F.col("trade_date").alias(d), F.col("i").alias(k)) for d, k in (("first_day", "a"), ("last_day", "z")))
    j = b.join(F.broadcast(lo), "first_day").join(F.broadcast(hi), "last_day")
    return j.select("ticker_id", "bars", "first_day", "last_day", F.greatest(F.col("z") - F.col("a") + 1 - F.col("bars"), F.lit(0)).cast("long").alias("missing"))


def field_depth(df: DataFrame, date_col: str, fields: list[str], cutoff: str, least: int = 24) -> DataFrame:
    """By field: first and last date and count of values, and TRAINABLE (starts by the cutoff, enough values), THIN or UNAVAILABLE."""
    long = df.select(date_col, *(F.col(f).cast("double") for f in fields)).unpivot([date_col], fields, "field", "value").filter("value is not null")
    got = long.groupBy("field").agg(F.min(date_col).alias("first_date"), F.max(date_col).alias("last_date"), F.count("*").alias("n"))
    names = df.sparkSession.createDataFrame([(f,) for f in fields], "field string")
    verdict = F.when(F.coalesce("n", F.lit(0)) == 0, "UNAVAILABLE").when((F.col("first_date") <= F.lit(cutoff).cast("date")) & (F.col("n") >= least), "TRAINABLE").otherwise("THIN")
    return names.join(got, "field", "left").select("field", "first_date", "last_date", F.coalesce("n", F.lit(0)).alias("n"), verdict.alias("verdict"))


def table_profile(df: DataFrame) -> DataFrame:
    """By column: rows, and bytes of the values as text (null 0)."""
    one = df.agg(F.count("*").alias("n"), *(F.sum(F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))).alias(c) for c in df.columns))
    return one.unpivot(["n"], df.columns, "column", "bytes").select("column", F.col("n").alias("n_rows"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def job_status(runs: DataFrame, predictions: DataFrame, now) -> DataFrame:
    """By ticker: the latest run's outcome; running for over 15 minutes means failed; ready where there are predictions."""
    w = Window.partitionBy("ticker_id").orderBy(F.desc("started_at"), F.desc("run_id"))
    last = runs.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    has = predictions.select("ticker_id").distinct().withColumn("__p", F.lit(True))
    late = F.col("started_at") < F.lit(now).cast("timestamp") - F.expr("INTERVAL 15 MINUTES")
    state = F.when(F.col("status") == "running", F.when(late, "failed").otherwise("running")).when(F.col("status") == "failed", "failed").when(F.coalesce("__p", F.lit(False)), "ready").otherwise("insufficient_history")
    return last.join(has, "ticker_id", "full").select("ticker_id", F.when(F.col("status").isNull(), "ready").otherwise(state).alias("state"))


def promote(models: DataFrame, model_id: int, at) -> DataFrame:
    """The registry with one production model: the named one; the former is retired."""
    new = F.when(F.col("model_id") == model_id, "production").when(F.col("status") == "production", "retired").otherwise(F.col("status"))
    return models.withColumn("promoted_at", F.when(F.col("model_id") == model_id, F.lit(at).cast("timestamp")).otherwise(F.col("promoted_at"))).withColumn("status", new)


def schedule(calendar: DataFrame) -> DataFrame:
    """Flags of each trading day: Friday, first trading day of its month, and the next trading day."""
    w = Window.orderBy("trade_date")
    month = Window.partitionBy(F.trunc("trade_date", "month"))
    d = calendar.select("trade_date").distinct()
    return d.select("trade_date", (F.dayofweek("trade_date") == 6).alias("friday"), (F.col("trade_date") == F.min("trade_date").over(month)).alias("first_of_month"), F.lead("trade_date").over(w).alias("next_day"))


def shift_trading_days(dates: DataFrame, calendar: DataFrame, n: int, on: str = "date") -> DataFrame:
    """Adds shifted: the trading day ``n`` days after (or before) each date; a date that is none counts from the next one, and 0 gives that."""
    cal = calendar.select("trade_date").distinct().withColumn("i", F.row_number().over(Window.orderBy("trade_date")))
    first = dates.select(on).distinct().join(F.broadcast(cal), F.col("trade_date") >= F.col(on)).groupBy(on).agg(F.min("i").alias("i"))
    there = cal.select(F.col("trade_date").alias("shifted"), (F.col("i") - n).alias("i"))
    return dates.join(first.join(F.broadcast(there), "i", "left").drop("i"), on, "left")
