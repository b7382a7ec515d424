"""Loading jobs: landed vendor rows to typed tables, idempotent upserts, drift and coverage checks."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load_history(tables: dict[str, DataFrame], columns: dict[str, list[str]], tickers: DataFrame | None = None, optional: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Each table pruned to its columns and, if given, to the tickers; a missing optional table is empty with the DDL schema."""
    out = {}
    for name, cols in columns.items():
        if name in tables:
            df = tables[name].select(*cols)
            out[name] = df.join(F.broadcast(tickers.select("ticker_id")), "ticker_id", "left_semi") if tickers is not None else df
        else:
            out[name] = next(iter(tables.values())).sparkSession.createDataFrame([], (optional or {})[name])
    return out


def cache_key(symbols: list[str]) -> str:
    return hashlib.sha1(",".join(sorted(set(symbols))).encode()).hexdigest()


def materialised(spark: SparkSession, folder: str, symbols: list[str], build, refresh: bool = False) -> DataFrame:
    """``build()`` written under the symbol set's key, and read from there next time; ``refresh`` overwrites."""
    path = f"{folder}/{cache_key(symbols)}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    if refresh or not there:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def bars_from_vendor(raw: DataFrame) -> DataFrame:
    """Typed bars: bad numbers become null, split 0 becomes 1, a missing dividend 0; rows without a date go."""
    num = lambda c: F.when(~F.isnan(F.col(c).try_cast("double")), F.col(c).try_cast("double"))
    return raw.select(
        "ticker_id", F.to_date("trade_date").alias("trade_date"), *(num(c).alias(c) for c in ("open", "high", "low", "close", "adj_close")), F.col("volume").try_cast("double").cast("long").alias("volume"),
        F.when(F.coalesce(num("split"), F.lit(0.0)) == 0, 1.0).otherwise(num("split")).alias("split"), F.coalesce(num("dividend"), F.lit(0.0)).alias("dividend"),
    ).filter("trade_date is not null")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Target with source rows inserted or put in place of rows of equal keys; the last by ``order`` of repeated source keys wins."""
    if order:
        source = source.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("__rn = 1").drop("__rn")
    else:
        source = source.dropDuplicates(keys)
    return target.join(source.select(*keys), keys, "left_anti").select(*target.columns).unionByName(source.select(*target.columns))


def insert_new(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target with those source rows, one for each key, whose keys it lacks."""
    return target.unionByName(source.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti").select(*target.columns))


def since(source: DataFrame, column: str, after) -> DataFrame:
    return source.filter(F.col(column) > after)


def detect_drift(stored: DataFrame, new: DataFrame, limit: float = 1e-3) -> DataFrame:
    """ticker_id, drifted: the earliest overlapping bar's adjusted price moved by more than ``limit``; null or 0 stored is no drift."""
    s = stored.select("ticker_id", "trade_date", F.col("adj_close").alias("old"))
    first = new.join(s, ["ticker_id", "trade_date"]).groupBy("ticker_id").agg(F.min_by(F.struct("adj_close", "old"), "trade_date").alias("x"))
    gap = F.abs(F.col("x.adj_close") - F.col("x.old")) / F.abs(F.nullif(F.col("x.old"), F.lit(0.0)))
    return first.select("ticker_id", F.coalesce(gap > limit, F.lit(False)).alias("drifted"))


def replace_drifted(stored: DataFrame, full: DataFrame, drift: DataFrame) -> DataFrame:
    """Stored history, with the full new history in place of drifted names'."""
    bad = drift.filter("drifted").select("ticker_id")
    return stored.join(bad, "ticker_id", "left_anti").unionByName(full.join(bad, "ticker_id", "left_semi").select(*stored.columns))


#: Reporting concepts by field, first choice first.
CONCEPTS = {
    "revenue": ["RevenueFromContractWithCustomerExcludingAssessedTax", "RevenueFromContractWithCustomerIncludingAssessedTax", "Revenues", "SalesRevenueNet"],
    "net_income": ["NetIncomeLoss"],
    "gross_profit": ["GrossProfit"],
    "cost_of_revenue": ["CostOfRevenue", "CostOfGoodsAndServicesSold", "CostOfGoodsSold"],
    "operating_income": ["OperatingIncomeLoss"],
    "equity": ["StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"],
    "lt_debt_noncurrent": ["LongTermDebtNoncurrent", "LongTermDebt"],
    "lt_debt_current": ["LongTermDebtCurrent"],
    "short_term_debt": ["ShortTermBorrowings"],
    "operating_cash_flow": ["NetCashProvidedByUsedInOperatingActivities"],
    "capex": ["PaymentsToAcquirePropertyPlantAndEquipment"],
}


def filings_from_facts(facts: DataFrame, concepts: dict[str, list[str]] | None = None) -> DataFrame:
    """One row for each filing (ticker_id, accn) from long facts (concept, start, end, val, accn, form, filed).

    Facts of an unnatural period (10-K 340-380 days, 10-Q 80-100; instants pass) or ended after filing
    go.  A filing's period ends at the latest end; of facts within 5 days of it the first concept in
    priority wins, then the latest end."""
    rows = [(f, c, i) for f, cs in (concepts or CONCEPTS).items() for i, c in enumerate(cs)]
    order = facts.sparkSession.createDataFrame(rows, "field string, concept string, priority int")
    days = F.datediff("end", "start")
    natural = F.col("start").isNull() | ((F.col("form") == "10-K") & days.between(340, 380)) | ((F.col("form") == "10-Q") & days.between(80, 100))
    f = facts.join(F.broadcast(order), "concept").filter(natural & (F.col("end") <= F.col("filed")))
    f = f.withColumn("period_end", F.max("end").over(Window.partitionBy("ticker_id", "accn"))).filter(F.abs(F.datediff("end", "period_end")) <= 5)
    wide = f.groupBy("ticker_id", "accn", "form", "period_end").pivot("field", list(concepts or CONCEPTS)).agg(F.min_by("val", F.struct("priority", -F.datediff("end", F.lit("1970-01-01")))))
    filed = f.groupBy("ticker_id", "accn").agg(F.max("filed").alias("filed_at"))
    wide = wide.join(filed, ["ticker_id", "accn"])
    debts = [F.col(c) for c in ("lt_debt_noncurrent", "lt_debt_current", "short_term_debt")]
    gross = F.coalesce("gross_profit", F.col("revenue") - F.col("cost_of_revenue"))
    ratio = lambda a: F.try_divide(a, F.when(F.col("revenue") != 0, F.col("revenue")))
    return wide.select(
        "ticker_id", F.col("accn").alias("accession_number"), F.col("form").alias("filing_type"), "period_end", "filed_at", "revenue", "net_income", ratio(gross).alias("gross_margin"), ratio(F.col("operating_income")).alias("operating_margin"),
        F.when(F.coalesce(*debts).isNotNull(), sum((F.coalesce(c, F.lit(0.0)) for c in debts), F.lit(0.0))).alias("total_debt"), F.col("equity").alias("total_equity"), (F.col("operating_cash_flow") - F.coalesce("capex", F.lit(0.0))).alias("fcf"),
    )


def columns_by_label(long: DataFrame, labels: list[tuple[str, str]], keys: list[str]) -> DataFrame:
    """Vendor rows (keys, label, value) to one row for each key: a label goes to the first field whose pattern it contains; all-null rows go."""
    fields = list(dict.fromkeys(f for _, f in labels))
    match = F.coalesce(*(F.when(F.lower("label").contains(p.lower()), F.lit(f)) for p, f in labels))
    return long.withColumn("__f", match).filter("__f is not null").groupBy(*keys).pivot("__f", fields).agg(F.first("value", ignorenulls=True)).na.drop("all", subset=fields)


def surprises_from_vendor(rows: DataFrame) -> DataFrame:
    return rows.filter("period_end is not null and report_date is not null and (eps_actual is not null or rev_actual is not null)")


def short_interest_from_records(records: DataFrame, tickers: DataFrame) -> DataFrame:
    """JSON records to rows; unknown symbols go; published 14 days after settlement."""
    r = records.select(F.from_json("record", "symbol string, settlementDate string, shortInterest double, averageDailyVolume double").alias("r")).select("r.*")
    r = r.withColumn("symbol", F.upper(F.trim("symbol"))).withColumn("settlement_date", F.expr("try_to_date(substr(settlementDate, 1, 10))")).filter("settlement_date is not null")
    r = r.join(F.broadcast(tickers.select("ticker_id", F.upper("symbol").alias("symbol"))), "symbol")
    return r.select("ticker_id", "settlement_date", F.date_add("settlement_date", 14).alias("publication_date"), F.col("shortInterest").alias("short_interest"), F.col("averageDailyVolume").alias("avg_daily_volume"))


def news_items(raw: DataFrame) -> DataFrame:
    """News JSON of two layouts (flat, or under ``content``; ISO or epoch times) to url, title, source, published_at; incomplete items go."""
    schema = "link string, title string, publisher string, providerPublishTime long, content struct<canonicalUrl:struct<url:string>,title:string,provider:struct<displayName:string>,pubDate:string>"
    j = raw.select("ticker_id", F.from_json("item", schema).alias("j"))
    out = j.select(
        "ticker_id", F.coalesce("j.content.canonicalUrl.url", "j.link").alias("url"), F.coalesce("j.content.title", "j.title").alias("title"), F.coalesce("j.content.provider.displayName", "j.publisher").alias("source"),
        F.coalesce(F.expr("try_to_timestamp(j.content.pubDate)"), F.timestamp_seconds("j.providerPublishTime")).alias("published_at"),
    )
    return out.filter("url is not null and title is not null and published_at is not null")


def normalize_symbol(c) -> Column:
    return F.upper(F.trim(F.replace(F.col(c) if isinstance(c, str) else c, F.lit("."), F.lit("-"))))


def table_rows(pages: DataFrame, row: str = "li", cell: str = r'<a href="([^"]*)">([^<]*)</a>') -> DataFrame:
    """page_id, pos, href, label of each ``row`` element of the pages' markup that holds a matching cell."""
    rows = F.regexp_extract_all("html", F.lit(rf"(?s)<{row}>(.*?)</{row}>"), F.lit(1))
    r = pages.select("page_id", F.posexplode(rows).alias("pos", "body"))
    return r.filter(F.col("body").rlike(cell)).select("page_id", "pos", F.regexp_extract("body", cell, 1).alias("href"), F.regexp_extract("body", cell, 2).alias("label"))


def date_in_formats(c: str, formats=("MMMM d, yyyy", "MMM d, yyyy", "yyyy-MM-dd")) -> Column:
    return F.coalesce(*(F.expr(f"try_to_date({c}, '{f}')") for f in formats))


def enrich_ids(tickers: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tickers with null external ids filled from (symbol, cik) as 10 digits; and the tickers that no mapping knows."""
    m = mapping.select(F.upper("symbol").alias("symbol"), F.lpad(F.col("cik").cast("string"), 10, "0").alias("__c"))
    j = tickers.join(F.broadcast(m), F.upper(tickers["symbol"]) == m["symbol"], "left").drop(m["symbol"])
    return j.withColumn("cik", F.coalesce("cik", "__c")).drop("__c"), tickers.join(m, F.upper(tickers["symbol"]) == m["symbol"], "left_anti")


def coverage_gap(tickers: DataFrame, prices: DataFrame, estimates: DataFrame) -> DataFrame:
    return tickers.join(prices.select("ticker_id"), "ticker_id", "left_semi").join(estimates.select("ticker_id"), "ticker_id", "left_anti")


def run_status(results: DataFrame) -> DataFrame:
    """One log row for each run_id of per-ticker results (rows, error): failed without rows but with errors, partial with both, else success."""
    r = results.groupBy("run_id").agg(F.sum("rows").alias("rows"), F.count("error").alias("errors"))
    return r.withColumn("status", F.when((F.col("errors") > 0) & (F.col("rows") == 0), "failed").when(F.col("errors") > 0, "partial").otherwise("success"))


#: Vendor sector names and the taxonomy's.
SECTOR_NAMES = {"Technology": "Information Technology", "Financial Services": "Financials", "Healthcare": "Health Care", "Consumer Cyclical": "Consumer Discretionary", "Consumer Defensive": "Consumer Staples", "Basic Materials": "Materials"}


def normalize_sector(df: DataFrame, known: list[str], mapping: dict[str, str] | None = None, column: str = "sector") -> DataFrame:
    """Vendor sectors by the map; names that are no known sector become null."""
    mapping = mapping or SECTOR_NAMES
    named = F.coalesce(F.get(F.filter(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in mapping.items())), lambda x: x["a"] == F.col(column)), F.lit(0))["b"], F.col(column))
    return df.withColumn(column, F.when(named.isin(known), named))


def merge_tickers(old: DataFrame, new: DataFrame) -> DataFrame:
    """Gaps of old rows filled from new ones by symbol, never overwritten; new and reactivated names are user_added."""
    n = new.select(F.upper("symbol").alias("symbol"), *(F.col(c).alias(f"__{c}") for c in ("name", "sector", "industry")))
    j = old.join(n, "symbol", "full")
    asked = F.coalesce("__name", "__sector", "__industry").isNotNull()
    return j.select(
        "symbol", *(F.coalesce(c, f"__{c}").alias(c) for c in ("name", "sector", "industry")),
        (F.coalesce("active", F.lit(False)) | asked).alias("active"), F.when(F.coalesce("active", F.lit(False)), F.col("user_added")).otherwise(F.when(asked, True).otherwise(F.coalesce("user_added", F.lit(False)))).alias("user_added"),
    )
