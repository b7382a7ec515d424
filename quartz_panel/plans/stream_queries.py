"""Queries of the streams with ordered and expiring state, beside the batch SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quartz_panel.operators.cut import cut
from quartz_panel.operators.serve import latest
from quartz_panel.sources import views as V
from quartz_panel.streaming import stateful as S
from quartz_panel.streaming import streams as T
from quartz_panel.streaming.bar_table import BarTable

from .evaluation_queries import _EWMA, RANKS, VIEWS, _ranked
from .factor_queries import oracle, rounded
from .registry import query
from .service_queries import LAST, stream_folder

#: Seconds that a quote lives in the query.
TTL = 6 * 3600


def run_upserted(stream, base: str, keys: list[str], order: str):
    """Runs a finite stream in update mode to its end; the rows by key as they stand then."""
    write, read = T.upsert_sink(f"{base}/table", keys, order)
    with S.rocksdb_state(stream.sparkSession):
        stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return read(stream.sparkSession)


def quote_stream(spark, folder: str, schema, base: str, closes, ttl: int, late: str = "0 seconds", max_files: int = 1):
    """Event files as a stream of quotes, a file for each batch."""
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", max_files).parquet(folder)
    quotes = events.select(F.col("user_id").cast("long").alias("ticker_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("seq"), F.col("value").cast("double").alias("price"))
    return run_upserted(S.live_quotes(quotes, closes, ttl, late), base, ["ticker_id"], "at").select("ticker_id", "price", "stale")


@query(
    "t03_quote_stream",
    oracle(f"SELECT e.user_id AS ticker_id, round(CASE WHEN fresh THEN e.value ELSE c.adj_close END * 1.0000001::DOUBLE, 4) AS price, NOT fresh AS stale FROM (SELECT user_id, arg_max(value, (ts, event_id)) AS value, epoch_ms(max(ts)) + {TTL * 1000} > (SELECT epoch_ms(max(ts)) FROM events) AS fresh FROM events GROUP BY user_id) e LEFT JOIN last_close c ON c.ticker_id = e.user_id", LAST),
)
def _(spark, d):
    closes = latest(V.bars(spark, d), "ticker_id", "trade_date", ["adj_close"])
    out = quote_stream(spark, f"{d}/events.parquet*", V.table(spark, d, "events").schema, stream_folder(spark, "quotes"), closes, TTL)
    return rounded(out.withColumn("price", F.col("price") * 1.0000001), digits=4)  # a nudge off the ties of rounding


def late_files(ranks, folder: str, months: int = 6) -> None:
    """Rows of ticker_id, horizon, date, rank as files of ``months`` months each; half of the rows arrive a file late, none in order.

    A file for each period of the calendar, written one after another as they would arrive."""
    n = ranks.select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy("date")) - 1)
    file = F.floor(F.col("k") / months) + F.pmod(F.xxhash64("ticker_id", "date"), F.lit(2))
    dealt = cut(ranks.join(F.broadcast(n), "date").withColumn("file", file.cast("int")).drop("k"))
    for k in range(dealt.agg(F.max("file")).first()[0] + 1):
        dealt.filter(F.col("file") == k).drop("file").orderBy(F.xxhash64("date", "ticker_id")).coalesce(1).write.mode("append").parquet(folder)


def smoothed_stream(spark, folder: str, schema, base: str, span: int, late: str, stored=None):
    ranks = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 1).parquet(folder)
    return run_upserted(S.ordered_smoothing(ranks, span, late, stored), base, ["ticker_id", "horizon", "date"], "smooth")


@query("t04_ordered_smoothing", oracle("SELECT ticker_id, date, smooth FROM walk_all", *VIEWS, RANKS, ("walk_all", _EWMA.replace("rk0", "rk"))))
def _(spark, d):
    """Ranks that arrive in files with late and unordered dates; the smoothed ranks are those of the batch."""
    base = stream_folder(spark, "ranks")
    ranks = _ranked(spark, d).select("ticker_id", F.lit("3M").alias("horizon"), "date", "rank")
    late_files(ranks, f"{base}/in")
    return rounded(smoothed_stream(spark, f"{base}/in", ranks.schema, base, 3, "400 days").select("ticker_id", "date", "smooth"))


def bar_stream(spark, folder: str, table: BarTable, base: str, max_files: int | None = None) -> None:
    """Bar files that have come since the stream last ran, into the table: as one batch, or ``max_files`` for each in their order."""
    source = spark.readStream.schema(table.schema).option("pathGlobFilter", "*.parquet")
    bars = (source.option("maxFilesPerTrigger", max_files) if max_files else source).parquet(folder)
    bars.writeStream.foreachBatch(table.write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()


@query(
    "t02_bar_drift_stream",
    oracle("""SELECT b.ticker_id, trade_date, round(adj_close * CASE WHEN b.ticker_id % 3 = 0 AND (drifted OR trade_date >= DATE '1999-12-01') THEN 1.01::DOUBLE ELSE 1 END * 1.0000001::DOUBLE, 2) AS adj_close, coalesce(drifted, false) AS drifted
  FROM bars b LEFT JOIN (SELECT DISTINCT ticker_id, ticker_id % 3 = 0 AS drifted FROM bars WHERE trade_date >= DATE '1999-12-01' AND trade_date < DATE '2000-01-01') o ON b.ticker_id = o.ticker_id"""),
)
def _(spark, d):
    """Bars to the end of 1999, then those from December on with every third name re-adjusted by a hundredth: its whole history follows."""
    base, bars = stream_folder(spark, "bars"), cut(V.bars(spark, d).select("ticker_id", "trade_date", "adj_close", "volume"))
    moved = bars.withColumn("adj_close", F.col("adj_close") * F.when(F.col("ticker_id") % 3 == 0, 1.01).otherwise(1.0))
    table = BarTable(f"{base}/table", bars.schema, 16, history=lambda names: moved.join(names, "ticker_id", "left_semi"))
    for part in (bars.filter("trade_date < date'2000-01-01'"), moved.filter("trade_date >= date'1999-12-01'")):
        part.write.mode("append").parquet(f"{base}/in")  # files of many tasks; the stream takes them up as they have come
        bar_stream(spark, f"{base}/in", table, base)
    out = table.read(spark).join(table.drifted(spark), "ticker_id", "left")
    return rounded(out.select("ticker_id", "trade_date", (F.col("adj_close") * 1.0000001).alias("adj_close"), F.coalesce("drifted", F.lit(False)).alias("drifted")), digits=2)
