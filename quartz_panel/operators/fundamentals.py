"""Point-in-time fundamentals: trailing sums, stability, growth, filing reaction, analyst figures, short interest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quartz_panel.functions.scalar import safe_ratio

from .asof import asof_join, lagged_asof
from .cut import cut
from .price import by_ticker

def by_filing():
    return Window.partitionBy("ticker_id").orderBy("filed_at", "accession_number")


def revenue_growth(filings: DataFrame, point_in_time: bool = False) -> DataFrame:
    """Adds revenue_growth over the filing of the same type nearest to a year earlier (within 30 days).

    As in the batch job this looks over all filings; ``point_in_time`` takes only those filed by then."""
    prior = filings.select(F.col("ticker_id").alias("__t"), F.col("filing_type").alias("__f"), F.col("period_end").alias("__e"), F.col("filed_at").alias("__filed"), F.col("accession_number").alias("__a"), F.col("revenue").alias("__rev"))
    gap = F.abs(F.datediff("__e", F.add_months("period_end", -12)))
    near = (F.col("ticker_id") == F.col("__t")) & (F.col("filing_type") == F.col("__f")) & (gap <= 30)
    if point_in_time:
        near &= F.col("__filed") <= F.col("filed_at")
    best = filings.join(prior, near).groupBy("accession_number").agg(F.min_by("__rev", F.struct(gap.alias("g"), F.col("__filed"), F.col("__a"))).alias("__prior"))
    growth = F.when((F.col("revenue") != 0) & (F.abs("__prior") > 1e-9), (F.col("revenue") - F.col("__prior")) / F.abs("__prior"))
    return filings.join(best, "accession_number", "left").withColumn("revenue_growth", F.coalesce(growth, F.lit(0.0))).drop("__prior")


def filing_ratios(filings: DataFrame) -> DataFrame:
    return filings.withColumn("debt_equity", safe_ratio("total_debt", "total_equity")).withColumn("fcf_revenue", safe_ratio("fcf", "revenue"))


def ttm(filings: DataFrame, metrics: tuple[str, ...] = ("revenue", "net_income", "fcf")) -> DataFrame:
    """Adds ttm_{metric}: four latest distinct quarters within 380 days, a 10-K's latest year, else the latest year within 380 days, else 0.

    Quarters and years are taken in the order filed; of a period filed twice the latest filing counts.  A metric's
    null takes no place among them.  All filings up to the row's own are looked at."""
    run = by_filing().rowsBetween(Window.unboundedPreceding, 0)
    df, kind = filings, F.col("filing_type")
    for m in metrics:
        item = F.struct(F.col("period_end").alias("p"), F.col(m).cast("double").alias("v"))
        held = lambda t, m=m, item=item: F.reverse(F.collect_list(F.when((kind == t) & F.col(m).isNotNull(), item)).over(run))
        df = df.withColumns({f"__q_{m}": held("10-Q"), f"__y_{m}": held("10-K")})
    for m in metrics:
        quarters, years = F.col(f"__q_{m}"), F.col(f"__y_{m}")
        none = F.slice(quarters, 1, 0)
        four = F.aggregate(quarters, none, lambda got, x: F.when((F.size(got) == 4) | F.exists(got, lambda y: y["p"] == x["p"]), got).otherwise(F.concat(got, F.array(x))))
        df = df.withColumn("__four", four)
        whole = (kind == "10-Q") & (F.size("__four") == 4) & (F.datediff("period_end", F.get("__four", F.lit(3))["p"]) <= 380)
        total = F.aggregate("__four", F.lit(0.0), lambda s, x: s + x["v"])
        within = F.filter(years, lambda y: F.abs(F.datediff(F.col("period_end"), y["p"])) <= 380)
        own_year = F.when(kind == "10-K", F.get(years, F.lit(0))["v"])
        df = df.withColumn(f"ttm_{m}", F.coalesce(own_year, F.when(whole, total), F.get(within, F.lit(0))["v"], F.lit(0.0)))
    return df.drop("__four", *(f"__{k}_{m}" for k in "qy" for m in metrics))


def margin_stability(filings: DataFrame, fields=("gross_margin", "operating_margin", "revenue_growth")) -> DataFrame:
    """Adds {field}_stability_4q: minus the population deviation over the last four filings, 0 for one alone."""
    w = by_filing().rowsBetween(-3, 0)
    return filings.select("*", *(F.when(F.count(f).over(w) >= 2, -F.stddev_pop(f).over(w)).otherwise(0.0).alias(f"{f}_stability_4q") for f in fields))


def annotated(filings: DataFrame) -> DataFrame:
    return margin_stability(ttm(filing_ratios(revenue_growth(filings))))


def valuation(rows: DataFrame) -> DataFrame:
    """Adds the price ratios of rows with adj_close, shares_outstanding and as-of fundamentals; no filing gives 0."""
    cap = F.col("adj_close") * F.col("shares_outstanding")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return rows.select(
        "*",
        safe_ratio(zero("ttm_net_income"), cap).alias("earnings_yield"),
        safe_ratio(zero("total_equity"), cap).alias("book_to_market"),
        safe_ratio(zero("ttm_revenue"), cap).alias("sales_to_price"),
        safe_ratio(zero("ttm_fcf"), cap).alias("fcf_yield"),
        safe_ratio(zero("ttm_net_income"), zero("total_equity")).alias("roe_ttm"),
        safe_ratio(zero("ttm_net_income"), zero("ttm_revenue")).alias("net_margin_ttm"),
        safe_ratio(zero("ttm_fcf"), zero("ttm_revenue")).alias("fcf_margin_ttm"),
    )


def filing_reaction(grid_bars: DataFrame, filings: DataFrame, bars: DataFrame, market: DataFrame) -> DataFrame:
    """ticker_id, date, filing_surprise_3d, filing_drift_30d, filings_recency_days, filings_in_90d.

    grid_bars: ticker_id, date, pos.  No bar beyond ``pos`` is looked at."""
    run = by_ticker().rowsBetween(Window.unboundedPreceding, 0)
    b = bars.join(F.broadcast(market), "trade_date", "left").withColumn("pos", F.row_number().over(by_ticker()) - 1).withColumn("cum", F.sum(F.coalesce("mkt", F.lit(0.0))).over(run))
    # bars around each bar by lag and lead; bars stay where their name is, only those that a filing or a grid row stands at go on
    around = {"before": F.lag, "after": F.lead}
    near_by = [(k, n, around[k]) for k, n in (("before", 1), ("after", 1), ("after", 31))]
    b = b.select("ticker_id", "trade_date", "pos", F.lag("trade_date").over(by_ticker()).alias("__prev"), F.struct(F.col("adj_close").alias("p"), F.col("cum").alias("c")).alias("own"))
    b = b.select("*", *(f("own", n).over(by_ticker()).alias(f"{k}_{n}") for k, n, f in near_by))
    wanted = filings.select("ticker_id", F.col("filed_at").alias("f"), F.lit(None).cast("int").alias("k")).unionByName(grid_bars.select("ticker_id", F.lit(None).cast("date").alias("f"), F.col("pos").cast("int").alias("k")))
    wanted = wanted.groupBy("ticker_id").agg(F.collect_set("f").alias("__files"), F.collect_set("k").alias("__at"))
    here = F.filter("__files", lambda f: (f <= F.col("trade_date")) & F.coalesce(f > F.col("__prev"), F.lit(True)))
    b = b.join(wanted, "ticker_id").withColumn("__files", here).withColumn("__at", F.array_contains("__at", F.col("pos").cast("int"))).filter("__at or size(__files) > 0")
    b = cut(b.drop("trade_date", "__prev"))
    first = b.select("ticker_id", F.explode("__files").alias("filed_at"), F.col("pos").alias("file_pos"), F.coalesce("before_1", "own").alias("s0"), F.col("after_1").alias("n1"), F.col("after_31").alias("n31"))
    placed = filings.select("ticker_id", "filed_at").distinct().join(first, ["ticker_id", "filed_at"], "left")
    g = asof_join(grid_bars.select("ticker_id", "date", "pos"), placed.withColumn("filed", F.col("filed_at")), ["ticker_id"], "date", "filed_at", ["filed", "file_pos", "s0", "n1", "n31"])
    g = g.join(b.filter("__at").select("ticker_id", "pos", "own"), ["ticker_id", "pos"], "left")
    fresh = F.coalesce(F.col("file_pos") <= F.col("pos"), F.lit(False)) & F.col("filed").isNotNull()
    ahead = lambda n: F.when(F.col("file_pos") + n <= F.col("pos"), F.col(f"n{n}")).otherwise(F.col("own"))
    values = {"s0": F.col("s0"), "s1": ahead(1), "d0": F.col("n1"), "d1": ahead(31)}
    g = g.select("*", *(F.when(fresh, v[x]).alias(f"{x}_{k}") for k, v in values.items() for x in "pc"), F.when(fresh, F.greatest(F.col("file_pos") - 1, F.lit(0))).alias("s0_at"), *(F.when(fresh, F.least(F.col("file_pos") + n, F.col("pos"))).alias(k) for k, n in (("s1_at", 1), ("d1_at", 31))), F.when(fresh, F.col("file_pos") + 1).alias("d0_at"))
    move = lambda a, z: F.when((F.col(f"p_{a}") > 0) & (F.col(f"p_{z}") > 0), F.ln(F.col(f"p_{z}") / F.col(f"p_{a}")) - (F.col(f"c_{z}") - F.col(f"c_{a}")))
    near = filings.select(F.col("ticker_id").alias("__t"), F.col("filed_at").alias("__f"))
    counted = grid_bars.join(near, (F.col("ticker_id") == F.col("__t")) & (F.col("__f") <= F.col("date")) & (F.col("__f") >= F.date_sub("date", 90))).groupBy("ticker_id", "date").count()
    return g.join(counted, ["ticker_id", "date"], "left").select(
        "ticker_id",
        "date",
        F.coalesce(F.when(F.col("s1_at") > F.col("s0_at"), move("s0", "s1")), F.lit(0.0)).alias("filing_surprise_3d"),
        F.coalesce(F.when(F.col("d1_at") - F.col("d0_at") >= 5, move("d0", "d1")), F.lit(0.0)).alias("filing_drift_30d"),
        F.coalesce(F.datediff("date", "filed").cast("double"), F.lit(0.0)).alias("filings_recency_days"),
        F.when(F.col("filed").isNotNull(), F.coalesce("count", F.lit(0)).cast("double")).otherwise(0.0).alias("filings_in_90d"),
    )


ESTIMATE_FIELDS = ["rec_mean", "price_target_mean", "eps_mean", "eps_std", "fwd_pe", "fwd_ev_ebitda", "num_analysts", "pt_num_estimates"]


def estimate_features(probes: DataFrame, estimates: DataFrame, surprises: DataFrame) -> DataFrame:
    """Analyst features of (ticker_id, date): levels, revisions, yields, surprises, coverage, dispersion; missing is 0."""
    p = lagged_asof(probes.select("ticker_id", "date"), estimates, ["ticker_id"], "date", "as_of_date", ESTIMATE_FIELDS, {"0": 0, "30": 30, "90": 90})
    beat = lambda a, c: F.when(F.col(a).isNotNull() & (F.col(c) != 0), (F.col(a) - F.col(c)) / F.abs(c))
    s = surprises.select("ticker_id", "report_date", beat("eps_actual", "eps_consensus").alias("eps_surprise"), beat("rev_actual", "rev_consensus").alias("revenue_surprise"))
    p = asof_join(p, s, ["ticker_id"], "date", "report_date", ["eps_surprise", "revenue_surprise"], per_column=True)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    v = lambda f, k="0": F.col(f"{f}_{k}")
    change = lambda f, k: zero(F.when(v(f, k) != 0, (v(f) - v(f, k)) / F.abs(v(f, k))))
    return p.select(
        "ticker_id", "date",
        zero(v("rec_mean")).alias("rec_mean_level"),
        zero(v("rec_mean", "30") - v("rec_mean")).alias("rec_rev_30d"),
        zero(v("rec_mean", "90") - v("rec_mean")).alias("rec_rev_90d"),
        zero(v("price_target_mean")).alias("price_target_mean"),
        change("price_target_mean", "90").alias("price_target_rev_90d"),
        zero(F.when(v("fwd_pe") > 0, 1 / v("fwd_pe"))).alias("forward_earnings_yield"),
        zero(F.when(v("fwd_ev_ebitda") > 0, 1 / v("fwd_ev_ebitda"))).alias("forward_ebitda_yield"),
        zero(F.col("revenue_surprise")).alias("revenue_surprise"),
        zero(F.col("eps_surprise")).alias("eps_surprise"),
        change("eps_mean", "30").alias("eps_est_rev_30d"),
        change("eps_mean", "90").alias("eps_est_rev_90d"),
        zero(v("num_analysts") - v("num_analysts", "90")).alias("coverage_chg_90d"),
        zero(v("pt_num_estimates")).alias("pt_num_estimates"),
        zero(F.when(F.abs(v("eps_mean")) >= 0.01, v("eps_std") / F.abs(v("eps_mean")))).alias("eps_dispersion"),
    )


def short_ratio(probes: DataFrame, short_interest: DataFrame) -> DataFrame:
    """ticker_id, date, short_ratio: days to cover if positive, else interest / average volume, else 0."""
    j = asof_join(probes.select("ticker_id", "date"), short_interest, ["ticker_id"], "date", "publication_date", ["days_to_cover", "short_interest", "avg_daily_volume"], tie=["settlement_date"])
    ratio = F.when(F.col("days_to_cover") > 0, F.col("days_to_cover")).when(F.col("avg_daily_volume") > 0, F.col("short_interest") / F.col("avg_daily_volume"))
    return j.select("ticker_id", "date", F.coalesce(ratio, F.lit(0.0)).alias("short_ratio"))
