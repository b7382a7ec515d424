"""Queries and SQL of loading, sentiment, serving, streaming and model operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import functions as F

from quartz_panel.operators import crosssection as X
from quartz_panel.operators import evaluate as E
from quartz_panel.operators import models as M
from quartz_panel.operators import price as P
from quartz_panel.operators import sentiment as N
from quartz_panel.operators import serve as R
from quartz_panel.operators.cut import cut
from quartz_panel.operators.sequences import SAMPLE_COLUMNS, sequence_samples, sequence_windows
from quartz_panel.sources import ingest as G
from quartz_panel.sources import views as V

from . import panel as L
from .evaluation_queries import RANKS, VIEWS, _ranked
from .factor_queries import _KNIFE_Q, KNIFE, knife_panel, oracle, rounded, sql_rank
from .registry import query

_BUCKET = "CAST((published_at AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') + INTERVAL 8 HOUR AS DATE)"
#: sums in ten-thousandths, means rounded half away from zero
_MEAN = "(sign(sum({v})) * ((2 * abs(sum({v})) + count(*)) // (2 * count(*))))::BIGINT"
DAILY = ("daily", f"SELECT ticker_id, {_BUCKET} AS score_date, {_MEAN.format(v='round(sentiment_score * 10000)::BIGINT')} AS m, count(*) AS headline_count FROM headlines GROUP BY ALL")
ROLL = ("rolled", "SELECT a.ticker_id, a.score_date, " + ", ".join(f"(SELECT {_MEAN.format(v='b.m')} FROM daily b WHERE b.ticker_id = a.ticker_id AND b.score_date BETWEEN a.score_date - {n - 1} AND a.score_date) / 10000.0 AS rolling_{n}d" for n in (7, 14)) + " FROM daily a")


def _daily(spark, d):
    return N.sentiment_daily(V.headlines(spark, d))


@query("p04_close_bucket", oracle(f"SELECT headline_id, {_BUCKET} AS score_date FROM headlines"))
def _(spark, d):
    from quartz_panel.functions.scalar import close_bucket

    return V.headlines(spark, d).select("headline_id", close_bucket("published_at").alias("score_date"))


@query("a02_sentiment_daily", oracle("SELECT ticker_id, score_date, m / 10000.0 + 0.0 AS mean_score, headline_count FROM daily", DAILY))
def _(spark, d):
    return _daily(spark, d).withColumn("mean_score", F.col("mean_score").cast("double") + 0.0)


@query("w21_rolling_sentiment", oracle("SELECT ticker_id, score_date, rolling_7d + 0.0 AS rolling_7d, rolling_14d + 0.0 AS rolling_14d FROM rolled", DAILY, ROLL))
def _(spark, d):
    r = N.rolling_sentiment(_daily(spark, d))
    return r.select("ticker_id", "score_date", *((F.col(c).cast("double") + 0.0).alias(c) for c in ("rolling_7d", "rolling_14d")))


@query("j05_bounded_fill", oracle("""SELECT g.ticker_id, g.date, CASE WHEN g.date - s.score_date <= 3 THEN s.score_date END AS score_date FROM (SELECT DISTINCT ticker_id, (DATE '2024-01-05' + (7 * k)::INT)::DATE AS date FROM daily CROSS JOIN range(5) t(k)) g
  ASOF LEFT JOIN daily s ON g.ticker_id = s.ticker_id AND g.date >= s.score_date""", DAILY))
def _(spark, d):
    from quartz_panel.operators.asof import asof_join

    daily = _daily(spark, d).withColumn("day", F.col("score_date"))
    probes = daily.select("ticker_id").distinct().crossJoin(spark.range(5).select(F.expr("date_add(DATE '2024-01-05', cast(7 * id as int))").alias("date")))
    return asof_join(probes, daily, ["ticker_id"], "date", "score_date", ["day"], tolerance_days=3).withColumnRenamed("day", "score_date")


@query("p05_signed_sentiment", "SELECT event_id, round(a - b, 6) + 0.0 AS score, CASE WHEN a = greatest(a, b, c) THEN 'pos' WHEN b = greatest(a, b, c) THEN 'neg' ELSE 'neu' END AS label FROM (SELECT event_id, (event_id % 7) / 10.0::DOUBLE AS a, (event_id % 5) / 10.0::DOUBLE AS b, 1.0::DOUBLE - (event_id % 7) / 10.0::DOUBLE - (event_id % 5) / 10.0::DOUBLE AS c FROM events)")
def _(spark, d):
    from quartz_panel.functions.scalar import signed_sentiment

    a, b = (F.col("event_id") % 7) / 10.0, (F.col("event_id") % 5) / 10.0
    e = V.table(spark, d, "events").select("event_id", a.alias("a"), b.alias("b"), (F.lit(1.0) - a - b).alias("c"))
    score, label = signed_sentiment("a", "b", "c")
    return rounded(e.select("event_id", score.alias("score"), label.alias("label")))


@query("u01_scored_texts")
def _(spark, d):
    def scorer(texts):
        return [((n := max(1, len(t.split()))) and t.lower().count("the ") / n, t.lower().count("de ") / n, 1.0) for t in texts]

    return N.score_texts(V.table(spark, d, "conversations").select("conv_id", "turn", "text"), "text", scorer).select("conv_id", "turn", "score", "label")


@query("s01_load_history", oracle("SELECT ticker_id, trade_date, adj_close FROM bars WHERE ticker_id IN (SELECT ticker_id FROM tickers WHERE active)"))
def _(spark, d):
    t = V.tickers(spark, d).filter("active")
    out = G.load_history({"bars": V.bars(spark, d)}, {"bars": ["ticker_id", "trade_date", "adj_close"], "notes": ["ticker_id"]}, t, {"notes": "ticker_id long"})
    assert out["notes"].columns == ["ticker_id"]
    return out["bars"]


@query("s02_materialised_history", oracle("SELECT ticker_id, count(*) AS n FROM bars GROUP BY ticker_id"))
def _(spark, d):
    folder = tempfile.mkdtemp(prefix="spark-history-") if spark.sparkContext.master.startswith("local[") else spark.conf.get("spark.checkpoint.dir") + "/history"
    return G.materialised(spark, folder, [d], lambda: V.bars(spark, d), refresh=True).groupBy("ticker_id").agg(F.count("*").alias("n"))


@query("s03_bars_from_vendor", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice END AS close, CASE WHEN l_discount = 0 THEN 1.0 ELSE l_discount END AS split, l_tax AS dividend, l_quantity::BIGINT AS volume FROM lineitem")
def _(spark, d):
    raw = V.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("ticker_id"), F.col("l_shipdate").cast("string").alias("trade_date"), F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.col("l_extendedprice").cast("string")).alias("close"),
        *(F.lit("1").alias(c) for c in ("open", "high", "low", "adj_close")), F.col("l_quantity").cast("string").alias("volume"), F.col("l_discount").cast("string").alias("split"), F.col("l_tax").cast("string").alias("dividend"),
    )
    keyed = G.bars_from_vendor(raw.withColumn("ticker_id", F.struct("l_orderkey", "l_linenumber")))
    return keyed.select("ticker_id.l_orderkey", "ticker_id.l_linenumber", "close", "split", "dividend", "volume")


_UPSERT = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0"


@query("s04_upsert", _UPSERT)
def _(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = o.filter("o_orderkey % 3 = 0").withColumn("v", F.lit(1)).unionByName(o.filter("o_orderkey % 3 = 0").withColumn("v", F.lit(2)).withColumn("o_orderstatus", F.lit("X")))
    return G.upsert(o.filter("o_orderkey % 2 = 0"), new, ["o_orderkey"], "v")


@query("s05_insert_new", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def _(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = o.filter("o_orderkey % 3 = 0")
    return G.insert_new(o.filter("o_orderkey % 2 = 0"), new.union(new).withColumn("o_orderstatus", F.col("o_orderstatus")), ["o_orderkey"])


@query("s06_incremental", oracle("SELECT ticker_id, settlement_date, short_interest FROM short_interest WHERE settlement_date > DATE '2001-01-01'"))
def _(spark, d):
    return G.since(V.short_interest(spark, d), "settlement_date", F.lit("2001-01-01").cast("date")).select("ticker_id", "settlement_date", "short_interest")


def _drift(spark, d):
    b = V.bars(spark, d)
    return b, b.filter("trade_date >= '2000-01-01'").withColumn("adj_close", F.when(F.col("ticker_id") % 3 == 0, F.col("adj_close") * 1.01).otherwise(F.col("adj_close")))


@query("s07_drift", oracle("SELECT ticker_id, ticker_id % 3 = 0 AS drifted FROM bars WHERE trade_date >= DATE '2000-01-01' GROUP BY ticker_id"))
def _(spark, d):
    return G.detect_drift(*_drift(spark, d))


@query("s07_replace_drifted", oracle("SELECT ticker_id, trade_date, round(adj_close * CASE WHEN ticker_id % 3 = 0 AND trade_date >= DATE '2000-01-01' THEN 1.01::DOUBLE ELSE 1 END * 1.0000001::DOUBLE, 2) AS adj_close FROM bars WHERE ticker_id % 3 <> 0 OR trade_date >= DATE '2000-01-01'"))
def _(spark, d):
    stored, new = _drift(spark, d)
    return rounded(G.replace_drifted(stored, new, G.detect_drift(stored, new)).select("ticker_id", "trade_date", (F.col("adj_close") * 1.0000001).alias("adj_close")), digits=2)


@query("s08_filings_from_facts", oracle("SELECT ticker_id, accession_number, filing_type, period_end, round(revenue, 5) AS revenue, round(total_debt, 5) AS total_debt, round(fcf, 5) + 0.0 AS fcf FROM filings"))
def _(spark, d):
    f = V.filings(spark, d)
    days = F.when(F.col("filing_type") == "10-K", 364).otherwise(90)
    fact = lambda concept, val, start=None, shift=0: F.struct(F.lit(concept).alias("concept"), (start if start is not None else F.date_sub("period_end", days)).alias("start"), F.date_sub("period_end", shift).alias("end"), val.alias("val"))
    none = F.lit(None).cast("date")
    facts = F.array(
        fact("Revenues", F.col("revenue")), fact("SalesRevenueNet", F.lit(-1.0)), fact("RevenueFromContractWithCustomerExcludingAssessedTax", F.lit(-2.0), F.date_sub("period_end", 200)), fact("NetIncomeLoss", F.col("net_income")),
        fact("LongTermDebt", F.col("total_debt"), none), fact("StockholdersEquity", F.col("total_equity"), none), fact("NetCashProvidedByUsedInOperatingActivities", F.col("fcf") + 5), fact("PaymentsToAcquirePropertyPlantAndEquipment", F.lit(5.0)),
        fact("GrossProfit", F.lit(-3.0), F.date_sub("period_end", 465), 100),
    )
    long = f.select("ticker_id", F.col("accession_number").alias("accn"), F.col("filing_type").alias("form"), F.col("filed_at").alias("filed"), F.explode(facts).alias("x")).select("ticker_id", "accn", "form", "filed", "x.*")
    return rounded(G.filings_from_facts(long).select("ticker_id", "accession_number", "filing_type", "period_end", "revenue", "total_debt", "fcf"), digits=5)


@query("s09_columns_by_label", oracle("SELECT ticker_id, as_of_date, eps_mean, num_analysts FROM estimates WHERE eps_mean IS NOT NULL OR num_analysts IS NOT NULL"))
def _(spark, d):
    e = V.estimates(spark, d)
    cells = F.array(F.struct(F.lit("Earnings Per Share - Mean").alias("label"), F.col("eps_mean").alias("value")), F.struct(F.lit("Number of Analysts").alias("label"), F.col("num_analysts").alias("value")), F.struct(F.lit("Other").alias("label"), F.lit(1.0).alias("value")))
    long = e.select("ticker_id", "as_of_date", F.explode(cells).alias("x")).select("ticker_id", "as_of_date", "x.*")
    return G.columns_by_label(long, [("per share - mean", "eps_mean"), ("number of analysts", "num_analysts")], ["ticker_id", "as_of_date"])


@query("s10_surprises_from_vendor", oracle("SELECT ticker_id, period_end, report_date FROM surprises WHERE eps_actual IS NOT NULL OR rev_actual IS NOT NULL"))
def _(spark, d):
    return G.surprises_from_vendor(V.surprises(spark, d)).select("ticker_id", "period_end", "report_date")


@query("s11_short_interest_records", oracle("SELECT ticker_id, settlement_date, publication_date, short_interest FROM short_interest WHERE ticker_id IN (SELECT ticker_id FROM tickers WHERE active)"))
def _(spark, d):
    s = V.short_interest(spark, d).join(V.tickers(spark, d).select("ticker_id", "symbol"), "ticker_id")
    record = F.to_json(F.struct(F.concat(F.lit(" "), F.lower("symbol")).alias("symbol"), F.concat(F.col("settlement_date").cast("string"), F.lit("T00:00")).alias("settlementDate"), F.col("short_interest").alias("shortInterest"), F.col("avg_daily_volume").alias("averageDailyVolume")))
    return G.short_interest_from_records(s.select(record.alias("record")), V.tickers(spark, d).filter("active")).drop("avg_daily_volume")


@query("s12_news_items", oracle("SELECT ticker_id, url, date_trunc('second', published_at) AS published_at FROM headlines WHERE headline_id % 5 <> 0"))
def _(spark, d):
    h = V.headlines(spark, d)
    flat = F.to_json(F.struct(F.col("url").alias("link"), F.lit("t").alias("title"), F.unix_timestamp("published_at").alias("providerPublishTime")))
    nested = F.to_json(F.struct(F.struct(F.struct("url").alias("canonicalUrl"), F.lit("t").alias("title"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("pubDate")).alias("content")))
    bad = F.to_json(F.struct(F.col("url").alias("link")))
    item = F.when(F.col("headline_id") % 5 == 0, bad).when(F.col("headline_id") % 2 == 0, flat).otherwise(nested)
    return G.news_items(h.select("ticker_id", item.alias("item"))).select("ticker_id", "url", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


@query("s13_table_rows", r"""SELECT page_id, pos::INT AS pos, regexp_extract(body, '<a href="([^"]*)">([^<]*)</a>', 1) AS href, regexp_extract(body, '<a href="([^"]*)">([^<]*)</a>', 2) AS label FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)) AS body, generate_subscripts(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1), 1) - 1 AS pos FROM pages) WHERE regexp_matches(body, '<a href="([^"]*)">([^<]*)</a>')""")
def _(spark, d):
    return G.table_rows(V.table(spark, d, "pages"))


@query("s14_enrich_ids", oracle("SELECT ticker_id, CASE WHEN ticker_id % 2 = 0 THEN 'kept' WHEN ticker_id % 3 = 0 THEN lpad(CAST(ticker_id + 7 AS VARCHAR), 10, '0') END AS cik FROM tickers"))
def _(spark, d):
    t = V.tickers(spark, d).select("ticker_id", "symbol", F.when(F.col("ticker_id") % 2 == 0, "kept").alias("cik"))
    m = V.tickers(spark, d).filter("ticker_id % 3 = 0").select(F.lower("symbol").alias("symbol"), (F.col("ticker_id") + 7).alias("cik"))
    return G.enrich_ids(t, m)[0].select("ticker_id", "cik")


@query("s15_coverage_gap", oracle("SELECT ticker_id FROM tickers WHERE ticker_id IN (SELECT ticker_id FROM bars) AND ticker_id NOT IN (SELECT ticker_id FROM estimates WHERE ticker_id % 4 <> 0)"))
def _(spark, d):
    return G.coverage_gap(V.tickers(spark, d), V.bars(spark, d), V.estimates(spark, d).filter("ticker_id % 4 <> 0")).select("ticker_id")


@query("s16_run_status", "SELECT user_id AS run_id, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END)::BIGINT AS rows, count(*) FILTER (event_type = 'error') AS errors, CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 'success' WHEN count(*) FILTER (event_type <> 'error') = 0 THEN 'failed' ELSE 'partial' END AS status FROM events GROUP BY user_id")
def _(spark, d):
    e = V.table(spark, d, "events")
    return G.run_status(e.select(F.col("user_id").alias("run_id"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("rows"), F.when(F.col("event_type") == "error", "x").alias("error")))


@query("s17_normalize_sector", oracle("SELECT ticker_id, CASE sector WHEN 'ASIA' THEN 'EAST' WHEN 'EUROPE' THEN 'EUROPE' END AS sector FROM tickers"))
def _(spark, d):
    return G.normalize_sector(V.tickers(spark, d).select("ticker_id", "sector"), ["EAST", "EUROPE"], {"ASIA": "EAST"})


@query("s18_merge_tickers", oracle("SELECT symbol, sector, active OR ticker_id % 2 = 0 AS active, CASE WHEN active THEN user_added WHEN ticker_id % 2 = 0 THEN true ELSE user_added END AS user_added FROM (SELECT * REPLACE (CASE WHEN ticker_id % 3 = 0 AND ticker_id % 2 <> 0 THEN NULL ELSE sector END AS sector) FROM tickers)"))
def _(spark, d):
    t = V.tickers(spark, d).withColumn("symbol", F.upper("symbol")).withColumn("name", F.lit("n"))
    old = t.withColumn("sector", F.when(F.col("ticker_id") % 3 != 0, F.col("sector")))
    out = G.merge_tickers(old, t.filter("ticker_id % 2 = 0"))
    names = V.tickers(spark, d).select(F.col("symbol").alias("own"), F.upper("symbol").alias("symbol"))
    return out.join(names, "symbol").select(F.col("own").alias("symbol"), "sector", "active", "user_added")


def _ohlc(spark, d):
    return V.bars(spark, d).select("*", (F.col("adj_close") * 2).alias("close"), (F.col("adj_close") * 1.5).alias("open"), (F.col("adj_close") * 3).alias("high"), F.col("adj_close").alias("low"))


@query("p10_adjusted_prices", oracle("SELECT ticker_id, trade_date, (adj_close * 1.5::DOUBLE) * (adj_close / (adj_close * 2)) AS open, (adj_close * 3) * (adj_close / (adj_close * 2)) AS high, adj_close * (adj_close / (adj_close * 2)) AS low, adj_close AS close FROM bars WHERE trade_date >= (SELECT max(trade_date) - 186 FROM bars)"))
def _(spark, d):
    return R.adjusted_prices(_ohlc(spark, d), "6m").drop("volume")


@query("p11_search_tickers", oracle("SELECT ticker_id, symbol FROM tickers WHERE active AND (lower(symbol) LIKE '%0000001%' OR lower(industry) LIKE '%0000001%') ORDER BY symbol LIMIT 10"))
def _(spark, d):
    return R.search_tickers(V.tickers(spark, d).withColumn("name", F.col("industry")), "0000001").select("ticker_id", "symbol")


def _ranked_now(spark, d):
    p = knife_panel(spark, d)
    last = p.join(F.broadcast(p.agg(F.max("date").alias("date"))), "date")
    return X.rank01(last, ["date"], "mom_6m", "score").join(V.tickers(spark, d).select("ticker_id", "symbol"), "ticker_id")


NOW = ("now_", f"SELECT k.ticker_id, k.date, k.sector, t.symbol, {sql_rank('mom_6m')} AS score, knife_score, mom_1m FROM (SELECT * FROM knife WHERE date = (SELECT max(date) FROM knife)) k JOIN tickers t ON k.ticker_id = t.ticker_id")


@query("p12_screener", oracle("SELECT ticker_id, round(score, 6) AS score FROM now_ WHERE sector IN ('ASIA', 'EUROPE', 'AMERICA') AND symbol LIKE '%0%'", _KNIFE_Q, KNIFE, NOW))
def _(spark, d):
    return rounded(R.screener(_ranked_now(spark, d), "0", ["ASIA", "EUROPE", "AMERICA"]).select("ticker_id", "score"))


@query("p13_display_tiers", oracle("SELECT date, ticker_id, CASE WHEN rank >= 0.66 THEN 'good' WHEN rank <= 0.34 THEN 'bad' ELSE 'neutral' END AS tone, CASE WHEN rank / 5 < 0.05 THEN 'steady' WHEN rank / 5 < 0.12 THEN 'moderate' ELSE 'shifting' END AS stability, CASE WHEN rank - 0.5 > 0.05 THEN 'positive' WHEN rank - 0.5 < -0.05 THEN 'negative' ELSE 'neutral' END AS sentiment FROM (SELECT date, ticker_id, round(rank, 6) AS rank FROM rk)", *VIEWS, RANKS))
def _(spark, d):
    r = _ranked(spark, d).withColumn("rank", F.round("rank", 6)).withColumn("s", F.col("rank") / 5).withColumn("m", F.col("rank") - 0.5)
    return r.select("date", "ticker_id", R.rank_tone("rank").alias("tone"), R.stability_label("s").alias("stability"), R.sentiment_tone("m").alias("sentiment"))


@query("p14_fundamentals_fallback", oracle("SELECT coalesce(f.ticker_id, q.ticker_id) AS ticker_id, CASE WHEN f.ticker_id IS NOT NULL THEN f.revenue ELSE q.revenue END AS revenue, CASE WHEN f.ticker_id IS NOT NULL THEN 'filing' ELSE 'vendor' END AS origin FROM (SELECT ticker_id, arg_max(revenue, filed_at) AS revenue FROM filings WHERE ticker_id % 2 = 0 GROUP BY ticker_id) f FULL JOIN (SELECT ticker_id, arg_max(revenue, period_end) AS revenue FROM quarters GROUP BY ticker_id) q ON f.ticker_id = q.ticker_id"))
def _(spark, d):
    f = R.latest(V.filings(spark, d).filter("ticker_id % 2 = 0"), "ticker_id", "filed_at", ["revenue"])
    return rounded(R.with_fallback(f, R.latest(V.quarters(spark, d), "ticker_id", "period_end", ["revenue"]), "ticker_id", ["revenue"]), digits=9)


@query("p15_zscore_array", oracle("SELECT ticker_id, list_transform(a, lambda x: round((x - list_avg(a)) / list_stddev_pop(a), 4) + 0.0) AS z FROM (SELECT ticker_id, list(adj_close ORDER BY trade_date) AS a FROM bars GROUP BY ticker_id)"))
def _(spark, d):
    from quartz_panel.functions.scalar import zscore_array

    a = V.bars(spark, d).groupBy("ticker_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("trade_date", "adj_close"))), lambda x: x["adj_close"]).alias("a"))
    return a.select("ticker_id", zscore_array("a").alias("z")).select("ticker_id", F.transform("z", lambda x: F.round(x, 4) + 0.0).alias("z"))


@query("p16_sparkline", oracle("SELECT ticker_id, trade_date, round(CASE WHEN hi > lo THEN (adj_close - lo) / (hi - lo) ELSE 0.5 END, 6) AS y, e >= f AS up FROM (SELECT *, min(adj_close) OVER w AS lo, max(adj_close) OVER w AS hi, arg_max(adj_close, rn) OVER w AS f, arg_min(adj_close, rn) OVER w AS e FROM (SELECT *, row_number() OVER (PARTITION BY ticker_id ORDER BY trade_date DESC) AS rn FROM bars) WHERE rn <= 30 WINDOW w AS (PARTITION BY ticker_id))"))
def _(spark, d):
    return rounded(R.sparkline(V.bars(spark, d)))


LAST = ("last_close", "SELECT ticker_id, arg_max(adj_close, trade_date) AS adj_close, max(trade_date) AS trade_date FROM bars GROUP BY ticker_id")


@query("j09_latest_row", oracle("SELECT h.user_id, h.ticker_id, c.adj_close, c.trade_date FROM holdings h LEFT JOIN last_close c ON h.ticker_id = c.ticker_id", LAST))
def _(spark, d):
    last = R.latest(V.bars(spark, d), "ticker_id", "trade_date", ["adj_close", "trade_date"])
    return V.holdings(spark, d).select("user_id", "ticker_id").join(last, "ticker_id", "left")


@query("j10_symbol_join", oracle("SELECT ticker_id, symbol FROM tickers WHERE ticker_id % 2 = 0"))
def _(spark, d):
    t = V.tickers(spark, d)
    asked = t.filter("ticker_id % 2 = 0").select(F.lower("symbol").alias("s"))
    return R.by_symbol(asked, t, "s").select("ticker_id", "symbol")


@query("j11_market_alignment", oracle("SELECT ticker_id, trade_date, round(mkt, 9) + 0.0 AS mkt FROM fx"))
def _(spark, d):
    b = V.bars(spark, d)
    return rounded(b.select("ticker_id", "trade_date").join(P.universe_returns(b), "trade_date", "left"), digits=9)


@query("j13_splice_rows", oracle("SELECT ticker_id, trade_date, CASE WHEN ticker_id = 3 THEN adj_close * 2 ELSE adj_close END AS adj_close FROM bars"))
def _(spark, d):
    b = V.bars(spark, d)
    fresh = b.filter("ticker_id = 3").withColumn("adj_close", F.col("adj_close") * 2)
    return R.spliced(b, fresh, ["ticker_id"]).select("ticker_id", "trade_date", "adj_close")


def _live(spark, d):
    last = R.latest(V.bars(spark, d), "ticker_id", "trade_date", ["adj_close"])
    return last.filter("ticker_id % 3 <> 0").select("ticker_id", (F.col("adj_close") * 1.1).alias("price"), F.when(F.col("ticker_id") % 3 == 1, F.col("adj_close")).otherwise(0.0).alias("prev_close"))


QUOTES = ("quotes", "SELECT ticker_id, CASE WHEN ticker_id % 3 <> 0 THEN adj_close * 1.1::DOUBLE ELSE adj_close END AS price, ticker_id % 3 = 0 AS stale, CASE ticker_id % 3 WHEN 0 THEN 0 WHEN 1 THEN adj_close * 1.1::DOUBLE - adj_close END AS change, CASE ticker_id % 3 WHEN 0 THEN 0 WHEN 1 THEN (adj_close * 1.1::DOUBLE - adj_close) / adj_close END AS change_pct FROM last_close")


@query("j14_quotes", oracle("SELECT ticker_id, price, stale, change, change_pct FROM quotes", LAST, QUOTES))
def _(spark, d):
    return R.quotes_with_fallback(_live(spark, d), V.bars(spark, d)).drop("prev_close")


@query("j15_active_predictions", oracle("SELECT n.ticker_id, symbol, round(score, 6) AS score FROM now_ n WHERE ticker_id IN (SELECT ticker_id FROM tickers WHERE active) AND ticker_id NOT IN (SELECT ticker_id FROM tickers WHERE user_added)", _KNIFE_Q, KNIFE, NOW))
def _(spark, d):
    p = R.active_only(_ranked_now(spark, d), V.tickers(spark, d))
    return rounded(p.select("ticker_id", "symbol", "score"))


@query("a10_filing_coverage", oracle("SELECT t.ticker_id, t.symbol, coalesce(count(*) FILTER (filing_type = '10-K'), 0) AS annual, coalesce(count(*) FILTER (filing_type = '10-Q'), 0) AS quarterly, min(filed_at) AS first_filed, max(filed_at) AS last_filed FROM tickers t LEFT JOIN filings f ON t.ticker_id = f.ticker_id GROUP BY t.ticker_id, t.symbol"))
def _(spark, d):
    return R.filing_coverage(V.filings(spark, d), V.tickers(spark, d))


@query("a11_lookahead_leaks", oracle("SELECT count(*) FILTER (filed_at < period_end) AS leaks FROM filings"))
def _(spark, d):
    return R.lookahead_leaks(V.filings(spark, d))


@query("a12_bar_coverage", oracle("SELECT ticker_id, bars, first_day, last_day, greatest((SELECT count(DISTINCT trade_date) FROM bars b WHERE b.trade_date BETWEEN first_day AND last_day) - bars, 0) AS missing FROM (SELECT ticker_id, count(*) AS bars, min(trade_date) AS first_day, max(trade_date) AS last_day FROM bars GROUP BY ticker_id)"))
def _(spark, d):
    return R.bar_coverage(V.bars(spark, d))


@query("a13_portfolio_value", oracle("""SELECT user_id, round(sum(shares * price), 4) AS value, round(sum(shares * coalesce(change, 0)), 4) + 0.0 AS day_change, round(sum(shares * coalesce(change, 0)) / nullif(sum(shares * price) - sum(shares * coalesce(change, 0)), 0), 6) + 0.0 AS day_pct,
  round((sum(shares * price) FILTER (cost_basis IS NOT NULL) - sum(shares * cost_basis)) / nullif(sum(shares * cost_basis), 0), 6) + 0.0 AS return_pct, count(cost_basis) < count(*) AS partial FROM holdings h JOIN quotes q ON h.ticker_id = q.ticker_id GROUP BY user_id""", LAST, QUOTES))
def _(spark, d):
    out = R.portfolio_value(V.holdings(spark, d), R.quotes_with_fallback(_live(spark, d), V.bars(spark, d)))
    return rounded(out.withColumn("value", F.round("value", 4)).withColumn("day_change", F.round("day_change", 4)))


@query("a16_field_depth", oracle("""SELECT f AS field, min(as_of_date) AS first_date, max(as_of_date) AS last_date, count(*) AS n, CASE WHEN min(as_of_date) <= DATE '1996-01-01' AND count(*) >= 24 THEN 'TRAINABLE' ELSE 'THIN' END AS verdict
  FROM (UNPIVOT (SELECT as_of_date, rec_mean, eps_mean, fwd_pe FROM estimates) ON rec_mean, eps_mean, fwd_pe INTO NAME f VALUE v) GROUP BY f UNION ALL SELECT 'missing', NULL, NULL, 0, 'UNAVAILABLE'"""))
def _(spark, d):
    return R.field_depth(V.estimates(spark, d).withColumn("missing", F.lit(None).cast("double")), "as_of_date", ["rec_mean", "eps_mean", "fwd_pe", "missing"], "1996-01-01")


@query("a17_table_profile", "SELECT 'c_name' AS \"column\", count(*) AS n_rows, sum(strlen(c_name))::BIGINT AS bytes FROM customer UNION ALL SELECT 'c_custkey', count(*), sum(strlen(c_custkey::VARCHAR))::BIGINT FROM customer UNION ALL SELECT 'c_mktsegment', count(*), sum(strlen(c_mktsegment))::BIGINT FROM customer")
def _(spark, d):
    return R.table_profile(V.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"))


def _models(spark, d):
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("model_id"), F.when(F.col("o_orderstatus") == "P", "production").otherwise("candidate").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")).alias("promoted_at"), F.col("o_orderdate").alias("created_at"))


MODELS = ("models", "SELECT o_orderkey AS model_id, CASE WHEN o_orderstatus = 'P' THEN 'production' ELSE 'candidate' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS promoted_at, o_orderdate AS created_at FROM orders")
_ACTIVE = "SELECT model_id FROM models ORDER BY CASE WHEN status = 'production' THEN 0 ELSE 1 END, promoted_at DESC NULLS LAST, created_at DESC, model_id LIMIT 1"


@query("q02_active_model", V.sql(_ACTIVE, MODELS))
def _(spark, d):
    return R.active_model(_models(spark, d)).select("model_id")


SHARPE = ("sharpes", """SELECT ticker_id, CASE WHEN count(r) >= 30 AND stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(252.0) END AS sharpe FROM (SELECT ticker_id, adj_close / lag(adj_close) OVER (PARTITION BY ticker_id ORDER BY trade_date) - 1 AS r FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker_id ORDER BY trade_date DESC) AS rn FROM bars WHERE trade_date >= (SELECT max(trade_date) - 420 FROM bars)) WHERE rn <= 252) WHERE r IS NOT NULL GROUP BY ticker_id""")


@query("q01_rankings", oracle("""SELECT ticker_id, symbol, date AS as_of_date, round(score, 6) AS score, CASE WHEN n >= 2 THEN rn || '/' || n END AS sector_label, round(sharpe, 6) AS sharpe FROM (
  SELECT t.*, row_number() OVER (PARTITION BY sector ORDER BY score DESC, ticker_id) AS rn, count(*) OVER (PARTITION BY sector) AS n FROM (SELECT * FROM now_ WHERE ticker_id NOT IN (SELECT ticker_id FROM tickers WHERE user_added) ORDER BY score DESC, ticker_id LIMIT 50) t) LEFT JOIN sharpes USING (ticker_id)""", _KNIFE_Q, KNIFE, NOW, SHARPE))
def _(spark, d):
    model = R.active_model(_models(spark, d)).select("model_id")
    p = _ranked(spark, d).unionByName(X.rank01(knife_panel(spark, d), ["date"], "mom_6m", "rank"), allowMissingColumns=True)
    p = X.rank01(knife_panel(spark, d), ["date"], "mom_6m", "score").select("ticker_id", F.col("date").alias("as_of_date"), "score", F.lit("6M").alias("horizon")).crossJoin(F.broadcast(model))
    out = R.rankings(p, V.tickers(spark, d), V.bars(spark, d), _models(spark, d), "bogus", 50)
    return rounded(out.select("ticker_id", "symbol", "as_of_date", "score", "sector_label", "sharpe"))


@query("q03_ticker_detail", oracle("""SELECT t.ticker_id, t.symbol, f.accession_number, c.adj_close, c.trade_date FROM tickers t LEFT JOIN (SELECT ticker_id, arg_max(accession_number, filed_at) AS accession_number FROM filings GROUP BY ticker_id) f ON t.ticker_id = f.ticker_id LEFT JOIN last_close c ON t.ticker_id = c.ticker_id""", LAST))
def _(spark, d):
    pred = _ranked(spark, d).select("ticker_id", F.lit("6M").alias("horizon"), F.col("date").alias("as_of_date"), F.col("rank").alias("score"))
    return R.ticker_detail(V.tickers(spark, d), pred, V.filings(spark, d), _daily(spark, d), V.bars(spark, d)).select("ticker_id", "symbol", "accession_number", "adj_close", "trade_date")


@query("q04_portfolio", oracle("SELECT h.ticker_id, t.symbol, h.shares, h.cost_basis, c.adj_close FROM holdings h JOIN tickers t ON h.ticker_id = t.ticker_id LEFT JOIN last_close c ON h.ticker_id = c.ticker_id WHERE h.user_id = 7", LAST))
def _(spark, d):
    return R.portfolio(V.holdings(spark, d), V.tickers(spark, d), V.bars(spark, d), 7).select("ticker_id", "symbol", "shares", "cost_basis", "adj_close")


@query("q05_holding_changes", oracle("SELECT user_id, ticker_id, CASE WHEN ticker_id % 4 = 1 THEN 5.0::DOUBLE ELSE shares END AS shares, CASE WHEN ticker_id % 4 = 1 THEN NULL WHEN ticker_id % 4 = 2 THEN 9.0::DOUBLE ELSE cost_basis END AS cost_basis FROM holdings WHERE ticker_id % 4 <> 3"))
def _(spark, d):
    h = V.holdings(spark, d)
    k = F.col("ticker_id") % 4
    changes = h.filter(k > 0).select("user_id", "ticker_id", F.when(k == 1, 5.0).alias("shares"), F.when(k == 2, 9.0).alias("cost_basis"), F.when(k == 1, "put").when(k == 2, "patch").otherwise("delete").alias("op"))
    return R.apply_holding_changes(h, changes)


@query("q06_job_status", """SELECT ticker_id, CASE WHEN status = 'running' THEN CASE WHEN ts < TIMESTAMP '2024-01-29 12:00:00' THEN 'failed' ELSE 'running' END WHEN status = 'failed' THEN 'failed' WHEN ticker_id % 2 = 0 THEN 'ready' ELSE 'insufficient_history' END AS state
  FROM (SELECT user_id AS ticker_id, CASE event_type WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'success' END AS status, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)""")
def _(spark, d):
    e = V.table(spark, d, "events")
    runs = e.select(F.col("user_id").alias("ticker_id"), F.col("event_id").alias("run_id"), F.col("ts").cast("timestamp").alias("started_at"), F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"))
    return R.job_status(runs, e.filter("user_id % 2 = 0").select(F.col("user_id").alias("ticker_id")), "2024-01-29 12:15:00")


@query("q07_promote", V.sql("SELECT model_id, CASE WHEN model_id = 5 THEN 'production' WHEN status = 'production' THEN 'retired' ELSE status END AS status FROM models", MODELS))
def _(spark, d):
    return R.promote(_models(spark, d), 5, "2024-01-01 00:00:00").select("model_id", "status")


@query("q08_union_names", oracle("SELECT ticker_id FROM bars UNION SELECT user_id FROM holdings"))
def _(spark, d):
    return V.bars(spark, d).select("ticker_id").union(V.holdings(spark, d).select("user_id")).distinct()


@query("q09_distinct_on", oracle("SELECT ticker_id, max(as_of_date) AS as_of_date, arg_max(num_analysts, as_of_date) AS num_analysts FROM estimates GROUP BY ticker_id"))
def _(spark, d):
    return R.latest(V.estimates(spark, d).withColumn("day", F.col("as_of_date")), "ticker_id", "as_of_date", ["day", "num_analysts"]).withColumnRenamed("day", "as_of_date")


@query("q10_heaviest_name", oracle("SELECT ticker_id, count(*) AS n FROM bars GROUP BY ticker_id ORDER BY n DESC, ticker_id LIMIT 1"))
def _(spark, d):
    return V.bars(spark, d).groupBy("ticker_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ticker_id").limit(1)


@query("q11_schedule", oracle("SELECT trade_date, dayofweek(trade_date) = 5 AS friday, trade_date = min(trade_date) OVER (PARTITION BY date_trunc('month', trade_date)) AS first_of_month, lead(trade_date) OVER (ORDER BY trade_date) AS next_day FROM (SELECT DISTINCT trade_date FROM bars)"))
def _(spark, d):
    return R.schedule(V.bars(spark, d))


@query("q11_shift_trading_days", oracle("SELECT f.filed_at, b.trade_date AS shifted FROM (SELECT filed_at, min(i) AS i FROM (SELECT DISTINCT filed_at FROM filings) JOIN days ON trade_date >= filed_at GROUP BY filed_at) f LEFT JOIN days b ON b.i = f.i + 5", ("days", "SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i FROM (SELECT DISTINCT trade_date FROM bars)")))
def _(spark, d):
    dates = V.filings(spark, d).select("filed_at").distinct()
    return R.shift_trading_days(dates, V.bars(spark, d), 5, "filed_at").filter(F.col("filed_at") <= V.bars(spark, d).agg(F.max("trade_date")).first()[0])


@query("x16_feature_columns", oracle("SELECT date, ticker_id, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in [*L.PACKS["price"], "max_ret_21d", "idio_vol"]) + " FROM panel"))
def _(spark, d):
    cols = L.feature_columns(("lottery",), base=("price",))
    return rounded(L.price_panel(spark, d).select("date", "ticker_id", *cols))


_RIDGE = ["mom_6m", "vol_60d"]


def _train(spark, d):
    p = rounded(L.price_panel(spark, d).filter("mask_3M").select("date", "ticker_id", "sector", *_RIDGE, "ma_gap_200", "dist_low_252", "r_3M"), digits=8)
    return X.knife_score(p)


@query(
    "m06_ridge",
    RIDGE_SQL := oracle("""SELECT round((sxy1 * (sx22 + 10) - sxy2 * sx12) / det, 4) + 0.0 AS b_mom, round((sxy2 * (sx11 + 10) - sxy1 * sx12) / det, 4) + 0.0 AS b_vol FROM (SELECT *, (sx11 + 10) * (sx22 + 10) - sx12 * sx12 AS det FROM (
  SELECT covar_pop(x1, y) * count(*) AS sxy1, covar_pop(x2, y) * count(*) AS sxy2, var_pop(x1) * count(*) AS sx11, var_pop(x2) * count(*) AS sx22, covar_pop(x1, x2) * count(*) AS sx12 FROM (SELECT round(mom_6m, 8) AS x1, round(vol_60d, 8) AS x2, round(r_3M, 8) AS y FROM panel WHERE mask_3M)))"""),
)
def _(spark, d):
    m = M.fit_ridge(_train(spark, d), _RIDGE, "r_3M")
    # the coefficients, as one row beside the table they were fitted on
    return _train(spark, d).limit(1).select((F.round(F.lit(float(m.coefficients[0])), 4) + 0.0).alias("b_mom"), (F.round(F.lit(float(m.coefficients[1])), 4) + 0.0).alias("b_vol"))


@query("m16_model_artefact", f"SELECT b_mom, b_vol, true AS same_digest, true AS told_apart, 0.0::DOUBLE AS gap, '3M' AS horizon FROM ({RIDGE_SQL})")
def _(spark, d):
    """A ridge saved twice and read back: its coefficients, whether both digests agree and other settings' differ, and the largest difference of a prediction."""
    t, base = cut(_train(spark, d)), stream_folder(spark, "model")
    m = M.fit_ridge(t, _RIDGE, "r_3M")
    one, two, other = (M.save_model(spark, m, {"horizon": "3M", "alpha": a}, f"{base}/{k}") for k, a in (("a", 10.0), ("b", 10.0), ("c", 1.0)))
    again, spec = M.load_model(spark, f"{base}/b")
    x, y = (M.predict([model], t, _RIDGE).select("date", "ticker_id", F.col("pred").alias(c)) for model, c in ((m, "x"), (again, "y")))
    gap = x.join(y, ["date", "ticker_id"]).agg(F.max(F.abs(F.col("x") - F.col("y"))).alias("gap"))
    b = [F.round(F.lit(float(v)), 4) + 0.0 for v in again.coefficients]
    return gap.select(b[0].alias("b_mom"), b[1].alias("b_vol"), F.lit(one == two).alias("same_digest"), F.lit(one != other).alias("told_apart"), "gap", F.lit(spec["horizon"]).alias("horizon"))


#: the features of the prepared panel
_FEATURES = [c for p in L.PACKS if p != "knife" for c in L.PACKS[p]]


def _prepared(spark, d):
    return L.prepared_panel(spark, d, ("3M",)).filter("mask_3M").select("date", "ticker_id", "knife_score", *_FEATURES, "r_3M")


@query("m05_boosted_trees")
def _(spark, d):
    t = _prepared(spark, d)  # reads a table
    return M.predict(M.fit_trees(t, _FEATURES, "r_3M", seeds=2), t, _FEATURES).select("date", "ticker_id", "pred")


@query("m08_single_split_compare")
def _(spark, d):
    t, cut = _train(spark, d).cache(), F.lit("2000-06-01").cast("date")
    a, b = (M.single_split(t, f, "r_3M", "r_3M", cut, M.fit_ridge) for f in (_RIDGE, _RIDGE[:1]))
    return M.compare(a, b, 5)


@query("m09_shuffled_labels", oracle("SELECT date, count(*) AS n, round(sum(round(r_3M, 8)), 5) + 0.0 AS total FROM panel WHERE mask_3M GROUP BY date"))
def _(spark, d):
    return M.shuffled_labels(_train(spark, d), "r_3M", 11).groupBy("date").agg(F.count("*").alias("n"), (F.round(F.sum("r_3M"), 5) + 0.0).alias("total"))


@query("m13_train_rows", oracle("SELECT date, ticker_id FROM panel WHERE mask_3M AND date < DATE '2001-01-01' AND ticker_id NOT IN (SELECT ticker_id FROM tickers WHERE user_added) AND date IN (SELECT DISTINCT date FROM panel WHERE mask_3M AND date < DATE '2001-01-01' AND ticker_id NOT IN (SELECT ticker_id FROM tickers WHERE user_added) ORDER BY date DESC LIMIT 10)"))
def _(spark, d):
    return M.train_rows(_train(spark, d), V.tickers(spark, d), F.lit("2001-01-01").cast("date"), "r_3M", 10).select("date", "ticker_id")


@query("m14_score_cross_section")
def _(spark, d):
    t = _train(spark, d).cache()
    last = t.join(F.broadcast(t.agg(F.max("date").alias("date"))), "date")
    return M.score_cross_section(last, [M.fit_ridge(t, _RIDGE, "r_3M")], _RIDGE, 0.2)


@query("m15_score_single")
def _(spark, d):
    t = _train(spark, d).cache()
    last = t.join(F.broadcast(t.agg(F.max("date").alias("date"))), "date")
    one = last.agg(F.min("ticker_id")).first()[0]
    return M.score_single(last, last, one, models=[M.fit_ridge(t, _RIDGE, "r_3M")], features=_RIDGE)


def stream_folder(spark, name: str) -> str:
    """A new folder for one run of a stream, in the one that driver and executors share; on ``local[...]`` alone a temporary one."""
    if spark.sparkContext.master.startswith("local["):
        return tempfile.mkdtemp(prefix="spark-stream-")
    return f"{spark.conf.get('spark.checkpoint.dir')}/{name}-{uuid.uuid4().hex}"


def _streamed(spark, d, build, mode="append", schema_of=None):
    """A file stream over the events table run to its end; the sink's rows."""
    from quartz_panel.streaming import streams as T  # noqa: F401

    base = stream_folder(spark, "stream")
    source = spark.readStream.schema(V.table(spark, d, "events").schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    q = build(source).writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def headline_stream(spark, d, max_files: int | None = None):
    """The events table as a stream of headlines: daily rows, those of open windows too.

    Headlines up to 14 days behind the batches before count; by default all waiting files are one batch, so none of
    them makes another's rows late."""
    from quartz_panel.streaming import streams as T

    base = stream_folder(spark, "headlines")
    write, read = T.upsert_sink(f"{base}/daily", ["bucket", "ticker_id", "score_date"], "headline_count")
    source = spark.readStream.schema(V.table(spark, d, "events").schema).option("pathGlobFilter", "*.parquet")
    events = (source.option("maxFilesPerTrigger", max_files) if max_files else source).parquet(f"{d}/events.parquet*")
    daily = T.headline_daily(V.headlines_of(events))
    daily.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return T.merge_daily(read(spark))


@query("t01_headline_stream", oracle("SELECT ticker_id, score_date, m / 10000.0 + 0.0 AS mean_score, headline_count FROM daily", DAILY))
def _(spark, d):
    return headline_stream(spark, d).withColumn("mean_score", F.col("mean_score").cast("double") + 0.0)


@query("t02_bar_upsert_stream", "SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def _(spark, d):
    from quartz_panel.streaming import streams as T

    base = stream_folder(spark, "upsert")
    write, read = T.upsert_sink(f"{base}/table", ["user_id"], "ts")
    source = spark.readStream.schema(V.table(spark, d, "events").schema).parquet(f"{d}/events.parquet*").select("user_id", "ts", "value")
    source.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return read(spark).select("user_id", "value")


@query("t03_quotes_or_close", oracle("SELECT e.user_id AS ticker_id, round(CASE WHEN epoch(TIMESTAMP '2024-01-30 00:00:00') - floor(epoch(e.ts)) <= 3600 THEN e.value ELSE c.adj_close END, 6) AS price, NOT (epoch(TIMESTAMP '2024-01-30 00:00:00') - floor(epoch(e.ts)) <= 3600) AS stale FROM (SELECT user_id, max(ts) AS ts, arg_max(value, ts) AS value FROM events GROUP BY user_id) e LEFT JOIN last_close c ON c.ticker_id = e.user_id", LAST))
def _(spark, d):
    from quartz_panel.streaming import streams as T

    quotes = T.latest_quotes(V.table(spark, d, "events").select(F.col("user_id").alias("ticker_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price")))
    return rounded(T.quotes_or_close(quotes, V.bars(spark, d), 3600, "2024-01-30 00:00:00"))


@query("t04_online_smoothing")
def _(spark, d):
    from quartz_panel.streaming import streams as T

    def build(e):
        return T.online_smoothing(e.select(F.col("user_id").alias("ticker_id"), F.lit("6M").alias("horizon"), F.to_date("ts").alias("date"), F.col("value").alias("rank")), 3)

    return _streamed(spark, d, build)


SEQUENCE = ("windows", "SELECT ticker_id, trade_date, pos, list(adj_close) OVER (PARTITION BY ticker_id ORDER BY trade_date ROWS BETWEEN 252 PRECEDING AND CURRENT ROW) AS a FROM px")


@query("w31_sequence_windows", oracle("SELECT ticker_id, trade_date, round(list_avg(r), 6) + 0.0 AS mean, round(list_stddev_pop(r), 6) AS dev, len(r)::INT AS n FROM (SELECT ticker_id, trade_date, list_transform(range(2, 254), lambda i: ln(a[i] / a[i - 1])) AS r FROM windows WHERE pos >= 252 AND (pos - 252) % 21 = 0)", SEQUENCE))
def _(spark, d):
    out = sequence_windows(V.bars(spark, d), 21).select("ticker_id", "trade_date", F.posexplode("returns").alias("i", "r"))
    return rounded(out.groupBy("ticker_id", "trade_date").agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("dev"), F.count("*").cast("int").alias("n")))


@query("w31_sequence_samples")
def _(spark, d):
    """Every window; of each column the mean of the values times their places, so that order counts."""
    placed = lambda x: x @ np.arange(1.0, 253.0) / 252
    out = sequence_samples(V.bars(spark, d), V.filings(spark, d), N.rolling_sentiment(_daily(spark, d)), summary=placed)
    return rounded(out.select("ticker_id", "trade_date", F.lit(252).alias("n"), *SAMPLE_COLUMNS))
