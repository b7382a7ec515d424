"""Domain views over the star-schema tables, in Spark and (for the oracle) in SQL.

Sums run on decimals and are divided as doubles, so that both engines give the same bits whatever
the order of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dec(c: str, scale: int = 2):
    return F.col(c).cast(f"decimal(12,{scale})")


def _double(x):
    return x.cast("double")


def tickers(spark, d) -> DataFrame:
    s, n, r = (table(spark, d, x) for x in ("supplier", "nation", "region"))
    return (
        s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
        .join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey)
        .select(
            F.col("s_suppkey").alias("ticker_id"),
            F.col("s_name").alias("symbol"),
            F.col("r_name").alias("sector"),
            F.col("n_name").alias("industry"),
            (F.lit(1000000) + 1000 * F.col("s_suppkey")).cast("double").alias("shares_outstanding"),
            (F.col("s_suppkey") % 10 != 0).alias("active"),
            (F.col("s_suppkey") % 25 == 0).alias("user_added"),
        )
    )


def _lines(spark, d) -> DataFrame:
    price, qty, disc, tax = _dec("l_extendedprice"), _dec("l_quantity"), _dec("l_discount"), _dec("l_tax")
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("ticker_id"),
        F.to_date("l_shipdate").alias("day"),
        price.alias("price"),
        qty.alias("qty"),
        (price * (1 - disc)).alias("net"),
        (price * tax).alias("taxed"),
        disc.alias("disc"),
        tax.alias("tax"),
        "l_returnflag",
        "l_orderkey",
    )


def bars(spark, d, block: int | None = None) -> DataFrame:
    """Daily bars: adj_close = traded value / quantity, volume = quantity.

    Lines are shuffled by name alone, so windows over a name's bars need no further shuffle.  ``block``: by blocks of so many names, with the block's number."""
    lines, by = (_lines(spark, d), ["ticker_id"]) if block is None else (_lines(spark, d).withColumn("block", F.floor(F.col("ticker_id") / block)), ["block"])
    keys = list(dict.fromkeys([*by, "ticker_id"]))
    return lines.repartition(*by).groupBy(*keys, F.col("day").alias("trade_date")).agg((_double(F.sum("price")) / _double(F.sum("qty"))).alias("adj_close"), _double(F.sum("qty")).alias("volume"))


def days(spark, d) -> DataFrame:
    """trade_date: the dates that any name has a bar on."""
    return _lines(spark, d).select(F.col("day").alias("trade_date")).distinct()


def _figures():
    n = _double(F.count("*"))
    return [
        _double(F.sum("net")).alias("revenue"),
        (_double(F.sum("net")) * 0.1 - _double(F.sum("taxed"))).alias("net_income"),
        (1 - _double(F.sum("disc")) / n).alias("gross_margin"),
        (1 - _double(F.sum("disc")) / n - _double(F.sum("tax")) / n).alias("operating_margin"),
        (_double(F.sum("qty")) * 100).alias("total_debt"),
        _double(F.sum("price")).alias("total_equity"),
    ]


def quarters(spark, d) -> DataFrame:
    end = F.last_day(F.add_months(F.trunc("day", "quarter"), 2))
    return _lines(spark, d).withColumn("period_end", end).groupBy("ticker_id", "period_end").agg(*_figures())


def filings(spark, d) -> DataFrame:
    """10-Q for the first three quarters, 10-K with the year's sums at its end; filed 45 days later."""
    end = F.last_day(F.add_months(F.trunc("day", "quarter"), 2))
    lines = _lines(spark, d).withColumn("q_end", end)
    year = lines.withColumn("period_end", F.make_date(F.year("day"), F.lit(12), F.lit(31))).groupBy("ticker_id", "period_end").agg(*_figures()).withColumn("filing_type", F.lit("10-K"))
    part = lines.filter("month(q_end) < 12").groupBy("ticker_id", F.col("q_end").alias("period_end")).agg(*_figures()).withColumn("filing_type", F.lit("10-Q"))
    return (
        year.unionByName(part)
        .withColumn("fcf", F.col("net_income") * 0.8)
        .withColumn("filed_at", F.date_add("period_end", 45))
        .withColumn("accession_number", F.concat(F.col("ticker_id").cast("string"), F.lit("-"), F.col("period_end").cast("string")))
    )


def estimates(spark, d) -> DataFrame:
    """Month-end analyst figures; each field is set in some months only."""
    m = _lines(spark, d).groupBy("ticker_id", F.last_day("day").alias("as_of_date")).agg(F.count("*").alias("n"), F.sum("qty").cast("long").alias("q"), _double(F.sum("price")).alias("p"))
    k = F.month("as_of_date")
    return m.select(
        "ticker_id",
        "as_of_date",
        F.when(k % 2 == 1, 1.0 + F.col("n") % 5).alias("rec_mean"),
        F.when(k % 3 == 0, F.col("p") / F.col("q") * 1.1).alias("price_target_mean"),
        F.when(k % 2 == 0, (F.col("q") % 200 - 40) / 10.0).alias("eps_mean"),
        F.when(k % 2 == 0, (F.col("q") % 13) / 100.0).alias("eps_std"),
        F.when(k % 2 == 0, 5.0 + F.col("n") % 20).alias("fwd_pe"),
        F.when(k % 4 == 1, 4.0 + F.col("q") % 17).alias("fwd_ev_ebitda"),
        _double(F.col("n")).alias("num_analysts"),
        F.when(k % 3 == 1, _double(F.col("n") % 7)).alias("pt_num_estimates"),
    )


def surprises(spark, d) -> DataFrame:
    w = Window.partitionBy("ticker_id").orderBy("period_end")
    return quarters(spark, d).select(
        "ticker_id",
        "period_end",
        F.date_add("period_end", 30).alias("report_date"),
        (F.lag("net_income").over(w) / 1e5).alias("eps_consensus"),
        (F.col("net_income") / 1e5).alias("eps_actual"),
        F.lag("revenue").over(w).alias("rev_consensus"),
        F.col("revenue").alias("rev_actual"),
    )


def short_interest(spark, d) -> DataFrame:
    half = F.when(F.dayofmonth("day") < 15, F.trunc("day", "month")).otherwise(F.date_add(F.trunc("day", "month"), 14))
    return (
        _lines(spark, d)
        .groupBy("ticker_id", half.alias("settlement_date"))
        .agg(_double(F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", F.col("qty"))), F.lit(0))).alias("short_interest"), (_double(F.sum("qty")) / _double(F.count("*"))).alias("avg_daily_volume"))
        .withColumn("publication_date", F.date_add("settlement_date", 14))
        .withColumn("days_to_cover", F.when(F.dayofmonth("settlement_date") == 1, F.col("short_interest") / F.col("avg_daily_volume")))
    )


def headlines(spark, d) -> DataFrame:
    return headlines_of(table(spark, d, "events"))


def headlines_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("headline_id"),
        F.col("user_id").alias("ticker_id"),
        F.col("ts").cast("timestamp").alias("published_at"),
        F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("url"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 50) / 100)).alias("sentiment_score"),
    )


def holdings(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), "o_orderpriority")
    j = _lines(spark, d).join(o, F.col("l_orderkey") == o.o_orderkey)
    cost = F.when(F.max(F.when(F.col("o_orderpriority") == "5-LOW", 1)).isNull(), _double(F.sum("price")) / _double(F.sum("qty")))
    return j.groupBy("user_id", "ticker_id").agg(_double(F.sum("qty")).alias("shares"), cost.alias("cost_basis"))


_LINES = """SELECT l_suppkey AS ticker_id, l_shipdate::DATE AS day, l_extendedprice::DECIMAL(12,2) AS price, l_quantity::DECIMAL(12,2) AS qty,
  l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(12,2)) AS net, l_extendedprice::DECIMAL(12,2) * l_tax::DECIMAL(12,2) AS taxed,
  l_discount::DECIMAL(12,2) AS disc, l_tax::DECIMAL(12,2) AS tax, l_returnflag, l_orderkey FROM lineitem"""
_FIGURES = """sum(net)::DOUBLE AS revenue, sum(net)::DOUBLE * 0.1::DOUBLE - sum(taxed)::DOUBLE AS net_income, 1 - sum(disc)::DOUBLE / count(*)::DOUBLE AS gross_margin,
  1 - sum(disc)::DOUBLE / count(*)::DOUBLE - sum(tax)::DOUBLE / count(*)::DOUBLE AS operating_margin, sum(qty)::DOUBLE * 100 AS total_debt, sum(price)::DOUBLE AS total_equity"""
_QUARTER_END = "last_day((date_trunc('quarter', day) + INTERVAL 2 MONTH)::DATE)"

#: The same views in SQL; a view may name earlier ones.
SQL = {
    "lines": _LINES,
    "tickers": """SELECT s_suppkey AS ticker_id, s_name AS symbol, r_name AS sector, n_name AS industry, (1000000 + 1000 * s_suppkey)::DOUBLE AS shares_outstanding,
  s_suppkey % 10 <> 0 AS active, s_suppkey % 25 = 0 AS user_added FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "bars": "SELECT ticker_id, day AS trade_date, sum(price)::DOUBLE / sum(qty)::DOUBLE AS adj_close, sum(qty)::DOUBLE AS volume FROM lines GROUP BY ticker_id, day",
    "quarters": f"SELECT ticker_id, {_QUARTER_END} AS period_end, {_FIGURES} FROM lines GROUP BY ALL",
    "filings": f"""SELECT *, net_income * 0.8::DOUBLE AS fcf, (period_end + 45)::DATE AS filed_at, ticker_id || '-' || period_end AS accession_number FROM (
  SELECT ticker_id, make_date(year(day), 12, 31) AS period_end, {_FIGURES}, '10-K' AS filing_type FROM lines GROUP BY ALL
  UNION ALL SELECT ticker_id, {_QUARTER_END} AS period_end, {_FIGURES}, '10-Q' AS filing_type FROM lines WHERE month({_QUARTER_END}) < 12 GROUP BY ALL)""",
    "estimates": """SELECT ticker_id, as_of_date, CASE WHEN k % 2 = 1 THEN 1.0::DOUBLE + n % 5 END AS rec_mean, CASE WHEN k % 3 = 0 THEN p / q * 1.1::DOUBLE END AS price_target_mean,
  CASE WHEN k % 2 = 0 THEN (q % 200 - 40) / 10.0::DOUBLE END AS eps_mean, CASE WHEN k % 2 = 0 THEN (q % 13) / 100.0::DOUBLE END AS eps_std, CASE WHEN k % 2 = 0 THEN 5.0::DOUBLE + n % 20 END AS fwd_pe,
  CASE WHEN k % 4 = 1 THEN 4.0::DOUBLE + q % 17 END AS fwd_ev_ebitda, n::DOUBLE AS num_analysts, CASE WHEN k % 3 = 1 THEN (n % 7)::DOUBLE END AS pt_num_estimates
  FROM (SELECT ticker_id, last_day(day) AS as_of_date, month(last_day(day)) AS k, count(*) AS n, sum(qty)::BIGINT AS q, sum(price)::DOUBLE AS p FROM lines GROUP BY ALL)""",
    "surprises": """SELECT ticker_id, period_end, (period_end + 30)::DATE AS report_date, lag(net_income) OVER w / 1e5 AS eps_consensus, net_income / 1e5 AS eps_actual,
  lag(revenue) OVER w AS rev_consensus, revenue AS rev_actual FROM quarters WINDOW w AS (PARTITION BY ticker_id ORDER BY period_end)""",
    "short_interest": """SELECT *, (settlement_date + 14)::DATE AS publication_date, CASE WHEN day(settlement_date) = 1 THEN short_interest / avg_daily_volume END AS days_to_cover FROM (
  SELECT ticker_id, CASE WHEN day(day) < 15 THEN date_trunc('month', day)::DATE ELSE (date_trunc('month', day)::DATE + 14)::DATE END AS settlement_date,
  coalesce(sum(qty) FILTER (l_returnflag = 'R'), 0)::DOUBLE AS short_interest, sum(qty)::DOUBLE / count(*)::DOUBLE AS avg_daily_volume FROM lines GROUP BY ALL)""",
    "headlines": """SELECT event_id AS headline_id, user_id AS ticker_id, ts AS published_at, 'u' || event_id AS url, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (value - 50) / 100)) AS sentiment_score FROM events""",
    "holdings": """SELECT o_custkey AS user_id, ticker_id, sum(qty)::DOUBLE AS shares, CASE WHEN max(CASE WHEN o_orderpriority = '5-LOW' THEN 1 END) IS NULL THEN sum(price)::DOUBLE / sum(qty)::DOUBLE END AS cost_basis
  FROM lines JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
    "grid": "SELECT max(trade_date) AS date FROM bars GROUP BY year(trade_date), month(trade_date)",
}


def sql(body: str, *more: tuple[str, str]) -> str:
    """``body`` with the views that it (or a view it needs) names; ``more``: further (name, sql) views."""
    import re

    known = dict(SQL) | dict(more)
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if re.search(rf"\b{name}\b", text) and name not in needed and known[name] is not text:
                visit(known[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    return "WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in needed) + "\n" + body if needed else body
