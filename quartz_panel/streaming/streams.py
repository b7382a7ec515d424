"""Structured Streaming forms of the daily jobs: late data are accepted as long as the batch jobs re-read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartz_panel.functions.scalar import close_bucket
from quartz_panel.operators.serve import latest


def headline_daily(headlines: DataFrame, late: str = "14 days") -> DataFrame:
    """Streaming daily means by (ticker, close-bucketed day) of headlines deduplicated by url within the watermark.

    The day is the window of the bucketed time, so a row up to ``late`` behind still counts.  In update mode each batch
    gives the changed windows with all that they hold so far; in append mode a window waits until the watermark passes it."""
    h = headlines.withWatermark("published_at", late).dropDuplicatesWithinWatermark(["url"])
    h = h.withColumn("bucket", F.window(F.col("published_at"), "1 day"))
    return h.groupBy("bucket", "ticker_id", close_bucket("published_at").alias("score_date")).agg(F.sum(F.col("sentiment_score").cast("decimal(10,6)")).alias("total"), F.count("*").alias("headline_count"))


def merge_daily(stored: DataFrame) -> DataFrame:
    """Windows' latest parts to one row for each (ticker, day)."""
    d = stored.groupBy("ticker_id", "score_date").agg(F.sum("total").alias("t"), F.sum("headline_count").alias("headline_count"))
    return d.select("ticker_id", "score_date", (F.col("t") / F.col("headline_count")).cast("decimal(6,4)").alias("mean_score"), "headline_count")


def upsert_sink(path: str, keys: list[str], order: str):
    """foreachBatch function that appends each micro-batch with its number; ``read_latest`` gives the upserted table.

    A repeated batch writes the same folder, so retries don't double rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    def read_latest(spark) -> DataFrame:
        rows = spark.read.parquet(path).drop("batch")
        columns = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct("__batch", order)).alias("x")).select(*keys, *(F.col("x")[c].alias(c) for c in columns if c != "__batch"))

    return write, read_latest


def latest_quotes(quotes: DataFrame) -> DataFrame:
    """Update-mode stream of each ticker's last quote (ticker_id, ts, price)."""
    return quotes.groupBy("ticker_id").agg(F.max_by("price", "ts").alias("price"), F.max("ts").alias("ts"))


def quotes_or_close(quotes: DataFrame, bars: DataFrame, ttl_seconds: int = 30, now=None) -> DataFrame:
    """Stream-static join: a quote no older than its time to live, or else the stored close, flagged stale."""
    now = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    close = latest(bars, "ticker_id", "trade_date", ["adj_close"])
    fresh = F.unix_timestamp(now) - F.unix_timestamp("ts") <= ttl_seconds
    j = quotes.join(close, "ticker_id", "left")
    return j.select("ticker_id", F.when(fresh, F.col("price")).otherwise(F.col("adj_close")).alias("price"), (~fresh).alias("stale"))


def smooth_state(alpha: float):
    """State function for applyInPandasWithState: the carried exponential mean of each key's ranks, in date order."""
    import pandas as pd

    def step(key, frames, state):
        value = state.get[0] if state.exists else None
        out = []
        for frame in sorted(frames, key=lambda f: f["date"].min()):
            for row in frame.sort_values("date").itertuples():
                value = row.rank if value is None else alpha * row.rank + (1 - alpha) * value
                out.append((*key, row.date, value))
        if value is not None:
            state.update((float(value),))
        yield pd.DataFrame(out, columns=["ticker_id", "horizon", "date", "smooth"])

    return step


def online_smoothing(ranks: DataFrame, span: int) -> DataFrame:
    """ranks: ticker_id, horizon, date, rank (a stream) to the same with ``smooth``; state is one number for each name and horizon."""
    return ranks.groupBy("ticker_id", "horizon").applyInPandasWithState(smooth_state(2 / (span + 1)), "ticker_id long, horizon string, date date, smooth double", "value double", "append", "NoTimeout")
