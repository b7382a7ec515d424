"""Streams with keyed state that orders and expires: smoothing in date order whatever the order of arrival, quotes with a time to live.

Both keep their state in RocksDB (``rocksdb_state``) and act on event time, by the watermark, so a
run over stored files gives the same rows as one over live ones."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, which lists, maps and timers need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


#: The ordinal of 1970-01-01, and a day's milliseconds.
EPOCH, DAY_MS = dt.date(1970, 1, 1).toordinal(), 86_400_000


class OrderedSmoother(StatefulProcessor):
    """Exponential mean of a key's ranks in date order.

    Days wait until the watermark has passed them; each batch smooths the waiting days anew from the carried mean, so a late day
    changes the days after it, which are given out again.  A day that has been passed moves into the mean at the key's next batch.  Days up
    to the carried one are known and ignored.  A key's state is one value, read once and written once a batch, without timers."""

    def __init__(self, alpha: float):
        self.alpha = alpha

    def init(self, handle) -> None:
        # days as ordinals; the carried day and mean, then the waiting days in order and their ranks
        self.state = handle.getValueState("state", "day int, smooth double, days array<int>, ranks array<double>")

    def _after(self, mean: float | None, rank: float | None) -> float | None:
        return mean if rank is None else (rank if mean is None else self.alpha * rank + (1 - self.alpha) * mean)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        day, mean, days, ranks = self.state.get() or (None, None, [], [])
        waiting, first = dict(zip(days, ranks, strict=True)), None
        for row in rows:
            at = row["date"].toordinal()
            if day is None or at > day:
                waiting[at] = None if row["rank"] is None or math.isnan(row["rank"]) else float(row["rank"])
                first = at if first is None else min(first, at)
        if first is None:
            return
        passed = timerValues.getCurrentWatermarkInMs()
        days, smooth = sorted(waiting), mean
        for at in days:
            smooth = self._after(smooth, waiting[at])
            if at >= first:
                yield Row(ticker_id=key[0], horizon=key[1], date=dt.date.fromordinal(at), smooth=smooth)
            if 0 < passed and (at - EPOCH) * DAY_MS < passed:
                day, mean = at, smooth
        days = [at for at in days if day is None or at > day]
        self.state.update((day, mean, days, [waiting[at] for at in days]))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        at, held = initialState["date"].toordinal(), self.state.get()
        if held is None or held[0] < at:
            self.state.update((at, initialState["smooth"], [], []))


def ordered_smoothing(ranks: DataFrame, span: int, late: str = "14 days", stored: DataFrame | None = None) -> DataFrame:
    """ranks: ticker_id, horizon, date, rank (a stream, in any order within ``late``) to ticker_id, horizon, date, smooth in update mode.

    The last row that a key's day gets is its value.  A null rank leaves the mean as it is; of two rows of one day the later batch counts.
    ``stored``: ticker_id, horizon, date, smooth of an earlier run, from which new days go on."""
    rows = ranks.withColumn("ts", F.col("date").cast("timestamp")).withWatermark("ts", late)
    start = stored.select("ticker_id", "horizon", "date", "smooth").groupBy("ticker_id", "horizon") if stored is not None else None
    return rows.groupBy("ticker_id", "horizon").transformWithState(OrderedSmoother(2 / (span + 1)), "ticker_id long, horizon string, date date, smooth double", "Update", "EventTime", initialState=start)


class LiveQuote(StatefulProcessor):
    """The latest quote of a key, until the watermark is ``ttl_ms`` beyond it; then the key is given out once more, without a price."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.quote = handle.getValueState("quote", "at long, seq long, price double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.quote.get() if self.quote.exists() else None
        best = held
        for frame in rows:
            row = frame.sort_values(["at", "seq"]).iloc[-1]
            if best is None or (row["at"], row["seq"]) > (best[0], best[1]):
                best = (int(row["at"]), int(row["seq"]), None if pd.isna(row["price"]) else float(row["price"]))
        if best is not held:
            if held is not None:
                self.handle.deleteTimer(held[0] // 1000 + self.ttl_ms)
            self.quote.update(best)
            self.handle.registerTimer(best[0] // 1000 + self.ttl_ms)
            yield pd.DataFrame({"ticker_id": [key[0]], "at": [best[0]], "price": [best[2]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.quote.exists():
            at = self.quote.get()[0]
            if at // 1000 + self.ttl_ms <= expiredTimerInfo.getExpiryTimeInMs():
                self.quote.clear()
                yield pd.DataFrame({"ticker_id": [key[0]], "at": [at], "price": [None]})


def live_quotes(quotes: DataFrame, closes: DataFrame, ttl_seconds: int = 30, late: str = "0 seconds") -> DataFrame:
    """quotes: ticker_id, ts, seq, price (a stream) to ticker_id, at (microseconds), price, stale in update mode.

    A key's last row counts: its latest quote (of equal times the larger ``seq``), or once that is ``ttl_seconds`` behind the watermark,
    the stored close, flagged stale.  Rows more than ``late`` behind the watermark's batch are dropped.  closes: ticker_id, adj_close, joined as a static table; a quote without a price takes it too."""
    rows = quotes.withColumn("at", F.unix_micros("ts")).withWatermark("ts", late)
    live = rows.groupBy("ticker_id").transformWithStateInPandas(LiveQuote(ttl_seconds * 1000), "ticker_id long, at long, price double", "Update", "EventTime")
    return live.join(closes.select("ticker_id", "adj_close"), "ticker_id", "left").select("ticker_id", "at", F.coalesce("price", "adj_close").alias("price"), F.col("price").isNull().alias("stale"))
