"""Evaluation of ranked predictions: long tables (date, ticker_id, pred, r, sector, ...), grouped aggregations only."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartz_panel.functions.scalar import safe_corr

from .crosssection import average_rank, knife_overlay, rank01


def rank_ic(pred: DataFrame, min_names: int = 30, by: tuple[str, ...] = ("date",), score: str = "pred", target: str = "r") -> DataFrame:
    """Spearman correlation of score and target in each group; pairs with a null are dropped, groups under ``min_names`` or without variance too."""
    p = pred.filter(F.col(score).isNotNull() & F.col(target).isNotNull() & ~F.isnan(F.col(score).cast("double")) & ~F.isnan(F.col(target).cast("double")))
    p = p.withColumn("__a", average_rank(score, *by)).withColumn("__b", average_rank(target, *by))
    return p.groupBy(*by).agg(safe_corr("__a", "__b").alias("ic"), F.count("*").alias("n")).filter((F.col("n") >= min_names) & F.col("ic").isNotNull())


def within_group_ic(pred: DataFrame, group: str = "sector", min_group: int = 10, by: tuple[str, ...] = ("date",)) -> DataFrame:
    """Mean over groups of ``min_group`` names or more of the rank correlation within the group."""
    ics = rank_ic(pred.filter(F.col(group).isNotNull()), min_group, (*by, group))
    return ics.groupBy(*by).agg(F.avg("ic").alias("ic"), F.count("*").alias("groups"))


def ic_summary(ics: DataFrame, *by: str) -> DataFrame:
    m, s, n = F.avg("ic"), F.stddev_samp("ic"), F.count("ic")
    return ics.groupBy(*by).agg(
        n.alias("n"), m.alias("mean"), s.alias("std"), F.try_divide(m, s).alias("icir"), F.try_divide(m, s / F.sqrt(n)).alias("t"), F.avg((F.col("ic") > 0).cast("double")).alias("hit_rate")
    )


def block_bootstrap(ics: DataFrame, block: int, reps: int = 2000, seed: int = 1337) -> DataFrame:
    """One row: n, mean, t_block, and for reps > 0 the moving-block interval, p (centred null), se and minimum detectable mean.

    The analytic t takes n / block independent values.  Draws are hashes of (seed, rep, block number)."""
    base = ics.agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "ic"))), lambda x: x["ic"]).alias("x"))
    base = base.withColumn("n", F.size("x")).withColumn("mean", F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.col("n"))
    dev = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + (v - F.col("mean")) * (v - F.col("mean"))) / F.nullif(F.col("n") - 1, F.lit(0)))
    base = base.withColumn("std", dev).withColumn("t_block", F.try_divide(F.col("mean"), F.col("std") / F.sqrt(F.greatest(F.col("n") / block, F.lit(1.0)))))
    if not reps:
        return base.drop("x")
    blocks = F.ceil(F.col("n") / block).cast("int")
    start = F.pmod(F.xxhash64(F.lit(seed), "rep", "k"), F.greatest(F.col("n") - block + 1, F.lit(1))).cast("int")
    draws = base.crossJoin(ics.sparkSession.range(reps).withColumnRenamed("id", "rep")).select("x", "n", "mean", "rep", F.explode(F.sequence(F.lit(1), blocks)).alias("k"))
    means = draws.select("rep", "mean", F.posexplode(F.slice("x", start + 1, block)).alias("i", "v"), "k", "n").filter((F.col("k") - 1) * block + F.col("i") < F.col("n")).groupBy("rep").agg(F.avg("v").alias("m"), F.first("mean").alias("mean"))
    stats = means.agg(F.percentile("m", F.lit(0.025)).alias("ci_low"), F.percentile("m", F.lit(0.975)).alias("ci_high"), F.avg((F.col("m") - F.col("mean") >= F.col("mean")).cast("double")).alias("p"), F.stddev_samp("m").alias("se"))
    return base.drop("x").crossJoin(stats).withColumn("min_detectable", 1.645 * F.col("se"))


def top_decile_risk(pred: DataFrame, rank: str = "pred", decile: float = 0.1, by: tuple[str, ...] = ()) -> DataFrame:
    """Means over dates of what the ceil(decile * n) best names have: knife, volatility percentile, share in a down-trend (percentile
    over 0.5), r, downside deviation, share under the date's 10th percentile of r."""
    keys = [*by, "date"]
    w = Window.partitionBy(*keys)
    p = pred.withColumn("__rn", F.row_number().over(w.orderBy(F.desc(rank), "ticker_id"))).withColumn("__n", F.count("*").over(w)).withColumn("__tail", F.percentile("r", F.lit(0.1)).over(w))
    p = p.filter(F.col("__rn") <= F.ceil(F.col("__n") * decile))
    day = p.groupBy(*keys).agg(
        F.avg("knife_score").alias("knife"), F.avg("vol_p").alias("vol"), F.avg((F.round("downtrend_p", 9) > 0.5).cast("double")).alias("downtrend"), F.avg("r").alias("mean_r"),
        F.sqrt(F.avg(F.least(F.col("r"), F.lit(0.0)) * F.least(F.col("r"), F.lit(0.0)))).alias("downside"), F.avg((F.col("r") < F.col("__tail")).cast("double")).alias("tail"),
    )
    return day.groupBy(*by).agg(*(F.avg(c).alias(c) for c in ("knife", "vol", "downtrend", "mean_r", "downside", "tail")), F.count("*").alias("dates"))


def feature_correlations(panel: DataFrame, candidates: list[str], book: list[str], top: int = 3) -> DataFrame:
    """For each candidate the ``top`` book features by mean absolute rank correlation over dates."""
    cols = list(dict.fromkeys([*candidates, *book]))
    long = panel.select("date", "ticker_id", *(F.col(c).cast("double") for c in cols)).unpivot(["date", "ticker_id"], cols, "f", "v")
    long = long.withColumn("k", average_rank("v", "date", "f"))
    a = long.filter(F.col("f").isin(candidates)).select("date", "ticker_id", F.col("f").alias("candidate"), F.col("k").alias("x"))
    b = long.filter(F.col("f").isin(book)).select("date", "ticker_id", F.col("f").alias("feature"), F.col("k").alias("y"))
    day = a.join(b, ["date", "ticker_id"]).filter("candidate <> feature").groupBy("date", "candidate", "feature").agg(safe_corr("x", "y").alias("c"))
    mean = day.groupBy("candidate", "feature").agg(F.avg(F.abs("c")).alias("mean_abs"))
    rn = F.row_number().over(Window.partitionBy("candidate").orderBy(F.desc("mean_abs"), "feature"))
    return mean.withColumn("place", rn).filter(F.col("place") <= top)


def regime_ic(pred: DataFrame, regime: str, min_names: int = 10) -> DataFrame:
    """Mean IC within the date's tertiles (0, 1, 2) of ``regime``."""
    w = Window.partitionBy("date")
    edge = F.percentile(regime, F.array(F.lit(0.33333), F.lit(0.66667))).over(w)
    p = pred.withColumn("__e", edge).withColumn("tertile", F.when(F.col(regime) <= F.col("__e")[0], 0).when(F.col(regime) <= F.col("__e")[1], 1).otherwise(2)).filter(F.col(regime).isNotNull())
    return rank_ic(p, min_names, ("date", "tertile")).groupBy("tertile").agg(F.avg("ic").alias("ic"), F.count("*").alias("dates"))


def sector_ranks(df: DataFrame, score: str = "score", group: str = "sector") -> DataFrame:
    """Adds sector_pct and sector_label ("place/n") within the group; null for a null group or a name alone."""
    w = Window.partitionBy(group)
    place, n = F.row_number().over(w.orderBy(F.desc(score), "ticker_id")), F.count("*").over(w)
    ok = F.col(group).isNotNull() & (n >= 2)
    return df.withColumn("sector_pct", F.when(ok, 1 - (place - 1) / (n - 1))).withColumn("sector_label", F.when(ok, F.concat_ws("/", place.cast("string"), n.cast("string"))))


def ewma_rank(ranks: DataFrame, span: int, by: tuple[str, ...] = ("ticker_id",), value: str = "rank") -> DataFrame:
    """Adds smooth: exponential mean of a name's ranks over its dates, seeded with the first; gaps don't decay.

    A name's dates are sorted once and smoothed in one pass; a null rank leaves the state as it is."""
    alpha = 2 / (span + 1) if span > 0 else 1.0

    def smooth(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("date", kind="stable")
        return frame.assign(smooth=frame[value].astype("float64").ewm(alpha=alpha, adjust=False, ignore_na=True).mean())

    rows = ranks.select(*by, "date", F.col(value).cast("double").alias(value))
    return rows.groupBy(*by).applyInPandas(smooth, T.StructType([*rows.schema.fields, T.StructField("smooth", T.DoubleType())]))


def rank_turnover(ranks: DataFrame, value: str = "rank", by: tuple[str, ...] = ()) -> DataFrame:
    """Mean over consecutive dates of the mean absolute rank change of the names on both."""
    dates = ranks.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")))
    r = ranks.select(*by, "ticker_id", "date", value).join(F.broadcast(dates), "date")
    a = r.select(*by, "ticker_id", "i", F.col(value).alias("x"))
    b = r.select(*by, "ticker_id", (F.col("i") - 1).alias("i"), F.col(value).alias("y"))
    day = a.join(b, [*by, "ticker_id", "i"]).groupBy(*by, "i").agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("m"))
    return day.groupBy(*by).agg(F.avg("m").alias("turnover"))


def knife_sweep(pred: DataFrame, lambdas: list[float], rank: str = "rank", min_names: int = 5) -> DataFrame:
    """IC, turnover and top-decile knife for each overlay weight, from the same predictions (nothing is refitted)."""
    grid = pred.crossJoin(F.broadcast(pred.sparkSession.createDataFrame([(float(x),) for x in lambdas], "lam double")))
    g = rank01(grid, ["lam", "date"], "knife_score", "__k").withColumn("__b", F.round((1 - F.col("lam")) * F.col(rank) - F.col("lam") * F.col("__k"), 9))
    g = rank01(g, ["lam", "date"], "__b", "__o").withColumn("over", F.when(F.col("lam") <= 0, F.col(rank)).otherwise(F.col("__o")))
    ic = rank_ic(g, min_names, ("lam", "date"), "over").groupBy("lam").agg(F.avg("ic").alias("ic"))
    turn = rank_turnover(g, "over", ("lam",))
    risk = top_decile_risk(g, "over", by=("lam",)).select("lam", "knife")
    return ic.join(turn, "lam").join(risk, "lam")


def blend_sweep(a: DataFrame, b: DataFrame, weights: list[float], min_names: int = 5) -> DataFrame:
    """IC and turnover of blends of two predictions matched by (date, ticker_id); names missing in ``b`` keep ``a``'s rank."""
    x = rank01(a, ["date"], "pred", "ra")
    y = rank01(b, ["date"], "pred", "rb").select("date", "ticker_id", "rb")
    j = x.join(y, ["date", "ticker_id"], "left").crossJoin(F.broadcast(a.sparkSession.createDataFrame([(float(w),) for w in weights], "w double")))
    j = j.withColumn("mixed", F.round((1 - F.col("w")) * F.col("ra") + F.col("w") * F.coalesce("rb", "ra"), 9))
    return rank_ic(j, min_names, ("w", "date"), "mixed").groupBy("w").agg(F.avg("ic").alias("ic")).join(rank_turnover(j, "mixed", ("w",)), "w")


def cross_horizon_shrink(pred: DataFrame, source: str = "1Y", toward: str = "6M", weight: float = 0.3) -> DataFrame:
    """Ranks of one horizon moved toward another's and re-ranked; others unchanged.  pred: date, ticker_id, horizon, rank."""
    other = pred.filter(F.col("horizon") == toward).select("date", "ticker_id", F.col("rank").alias("__o"))
    own = pred.filter(F.col("horizon") == source).join(other, ["date", "ticker_id"], "left")
    own = own.withColumn("__m", F.round((1 - weight) * F.col("rank") + weight * F.coalesce("__o", "rank"), 9)).drop("rank", "__o")
    return pred.filter(F.col("horizon") != source).unionByName(rank01(own, ["date", "horizon"], "__m", "rank").drop("__m").select(*pred.columns))


def smooth_to_prior(current: DataFrame, prior: DataFrame, span: int) -> DataFrame:
    """One exponential step of ``rank`` from the last stored rank (ticker_id, horizon, prior_rank), re-ranked by horizon."""
    alpha = 2 / (span + 1) if span > 0 else 1.0
    j = current.join(prior.select("ticker_id", "horizon", "prior_rank"), ["ticker_id", "horizon"], "left")
    j = j.withColumn("__s", F.round(F.coalesce(alpha * F.col("rank") + (1 - alpha) * F.col("prior_rank"), F.col("rank")), 9)).drop("rank", "prior_rank")
    return rank01(j, ["horizon"], "__s", "rank").drop("__s")


def prediction_metrics(pred: DataFrame, min_names: int = 10) -> DataFrame:
    """Per horizon: n, accuracy, Brier score, base rate, lift, RMSE, MAE, IC of (prob, r_hat, y, r, mask)."""
    p = pred.filter("mask")
    y = F.col("y").cast("double")
    hit = ((F.col("prob") >= 0.5) == F.col("y")).cast("double")
    out = p.groupBy("horizon").agg(
        F.count("*").alias("n"), F.avg(hit).alias("accuracy"), F.avg((F.col("prob") - y) * (F.col("prob") - y)).alias("brier"), F.avg(y).alias("base_rate"),
        F.sqrt(F.avg((F.col("r_hat") - F.col("r")) * (F.col("r_hat") - F.col("r")))).alias("rmse"), F.avg(F.abs(F.col("r_hat") - F.col("r"))).alias("mae"),
    )
    ic = rank_ic(p, min_names, ("horizon", "date"), "r_hat").groupBy("horizon").agg(F.avg("ic").alias("ic"))
    return out.withColumn("lift", F.col("accuracy") - F.greatest(F.col("base_rate"), 1 - F.col("base_rate"))).join(ic, "horizon", "left")


def return_scale(long: DataFrame) -> DataFrame:
    """Per horizon the population deviation of unmasked returns, at least 1e-4; 1 for one row or none."""
    s = F.stddev_pop(F.when(F.col("mask"), F.col("r")))
    return long.groupBy("horizon").agg(F.when(F.count(F.when(F.col("mask"), 1)) <= 1, 1.0).otherwise(F.greatest(s, F.lit(1e-4))).alias("scale"))


def class_weights(long: DataFrame, power: float = 0.5) -> DataFrame:
    """Per horizon weights frequency ** -power of the two classes, with mean 1."""
    f = long.filter("mask").groupBy("horizon", "y").agg(F.count("*").alias("c"))
    w = Window.partitionBy("horizon")
    raw = F.pow(F.col("c") / F.sum("c").over(w), F.lit(-power))
    return f.withColumn("raw", raw).withColumn("weight", F.col("raw") / F.avg("raw").over(w)).select("horizon", "y", "weight")


def embargo_months(horizon_bars: int) -> int:
    return max(1, math.ceil(horizon_bars / 21))


def walk_forward_folds(dates: DataFrame, horizon_bars: int, min_train: int = 12, window: int | None = None) -> DataFrame:
    """fold dates: test_date, cutoff (last training date, ceil(h / 21) month ends before it), lower (first training date, ``window`` month ends before the cutoff)."""
    gap = embargo_months(horizon_bars)
    d = dates.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    t = d.filter(F.col("i") >= min_train + gap).select(F.col("date").alias("test_date"), F.col("i").alias("t"))
    cut = d.select(F.col("date").alias("cutoff"), F.col("i").alias("c"))
    low = d.select(F.col("date").alias("lower"), F.col("i").alias("l"))
    first = F.greatest(F.col("t") - gap - (window or 0), F.lit(0)) if window else F.lit(0)
    return t.join(F.broadcast(cut), F.col("c") == F.col("t") - gap).join(F.broadcast(low), F.col("l") == first).select("test_date", "cutoff", "lower")


def prior_ranks(stored: DataFrame, before: str, n: int) -> DataFrame:
    """The last ``n`` stored ranks of each (ticker_id, horizon) before a date, rn 1 the latest; of a date stored twice the one created last."""
    one = Window.partitionBy("ticker_id", "horizon", "as_of_date").orderBy(F.desc("created_at"))
    last = Window.partitionBy("ticker_id", "horizon").orderBy(F.desc("as_of_date"))
    s = stored.filter(F.col("as_of_date") < F.lit(before).cast("date")).withColumn("k", F.row_number().over(one)).filter("k = 1")
    return s.withColumn("rn", F.row_number().over(last)).filter(F.col("rn") <= n).drop("k")


def rank_stability(ranks: DataFrame) -> DataFrame:
    """ticker_id, horizon, stability: population deviation of the ranks, null for fewer than two."""
    return ranks.groupBy("ticker_id", "horizon").agg(F.when(F.count("rank") >= 2, F.stddev_pop("rank")).alias("stability"))


def matched_mix(a: DataFrame, b: DataFrame, x: str, y: str, weight: float, out: str) -> DataFrame:
    """``a`` with (1 - weight) * x + weight * y, y from ``b``'s row of the same date and name; a name missing in ``b`` keeps x."""
    other = b.select("date", "ticker_id", F.col(y).alias("__y"))
    return a.join(other, ["date", "ticker_id"], "left").withColumn(out, (1 - weight) * F.col(x) + weight * F.coalesce("__y", x)).drop("__y")


def time_part(date: str, end, val_months: int, holdout_months: int):
    """train, val or holdout by months before ``end``: val begins ``val_months`` before it, the holdout ``holdout_months``."""
    return F.when(F.col(date) < F.add_months(end, -val_months), "train").when(F.col(date) < F.add_months(end, -holdout_months), "val").otherwise("holdout")


def strided_samples(bars: DataFrame, first: int, stride: int, masks: list[str]) -> DataFrame:
    """Every ``stride``-th bar of a name from place ``first`` on that has at least one label."""
    some = F.greatest(*(F.coalesce(F.col(m), F.lit(False)) for m in masks)) if len(masks) > 1 else F.coalesce(F.col(masks[0]), F.lit(False))
    return bars.filter((F.col("pos") >= first) & ((F.col("pos") - first) % stride == 0) & some)


def window_facts(rows: DataFrame, *by: str) -> DataFrame:
    """start, end, n_rows and names of training rows; of none: null dates and zeros."""
    return rows.groupBy(*by).agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("n_rows"), F.countDistinct("ticker_id").alias("names"))


__all__ = [n for n in dir() if not n.startswith("_")] + ["knife_overlay"]
