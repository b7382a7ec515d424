"""Scores of added names by insertion into a stored cross-section: places are counted, members are not ranked again."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .crosssection import average_rank, counted

#: Rows (added names x features) that are broadcast to the stored ranks; more are joined by a shuffle.
MOST_BROADCAST_ROWS = 100_000
#: What a score may differ by besides its features' moves: its own rounding.
SLACK = 1e-6


def _long(df: DataFrame, features: list[str], value: str) -> DataFrame:
    return df.select("date", "ticker_id", *(F.col(c).cast("double") for c in features)).unpivot(["date", "ticker_id"], features, "feature", value)


def stored_ranks(members: DataFrame, features: list[str]) -> DataFrame:
    """date, ticker_id, feature, v, place (average rank from 1) and n: the cross-section as it is stored, ranked once."""
    long = _long(members, features, "v")
    return long.select("*", average_rank("v", "date", "feature").alias("place"), counted("v", "date", "feature").alias("n"))


def _scaled(place, n):
    return F.when(n < 2, 0.0).otherwise(2 * (place - 1) / F.greatest(n - 1, F.lit(1)) - 1)


def inserted(stored: DataFrame, fresh: DataFrame, features: list[str]) -> DataFrame:
    """date, added_id, ticker_id and each feature in [-1, 1]: for each added name, all members and the name itself, as ranked together.

    The name's place is one more than the members below it and half of those it ties with; a member's place rises by one where
    the name is below it, by a half where they tie, and falls likewise for an old row of the name among the members, which goes.
    So values equal those of ranking members and name anew.  A null value has no rank and moves nobody."""
    new = _long(fresh, features, "x").withColumnRenamed("ticker_id", "added_id")
    old = stored.select("date", "feature", F.col("ticker_id").alias("added_id"), F.col("v").alias("old"))
    new = new.join(old, ["date", "feature", "added_id"], "left")
    small = fresh.count() * len(features) <= MOST_BROADCAST_ROWS
    others = stored.join(F.broadcast(new) if small else new, ["date", "feature"]).filter("ticker_id <> added_id")
    above = lambda x: F.coalesce((F.col(x) < F.col("v")).cast("int") + 0.5 * (F.col(x) == F.col("v")).cast("int"), F.lit(0.0))
    there = lambda x: F.col(x).isNotNull().cast("int")
    moved = others.select("date", "added_id", "ticker_id", "feature", F.when(F.col("v").isNotNull(), _scaled(F.col("place") + above("x") - above("old"), F.col("n") + there("x") - there("old"))).alias("s"))
    below = (F.col("v") < F.col("x")).cast("int") + 0.5 * (F.col("v") == F.col("x")).cast("int")
    met = others.groupBy("date", "added_id", "feature").agg(F.coalesce(F.sum(below), F.lit(0.0)).alias("__b"), F.count("v").alias("__n"))
    mine = new.join(met, ["date", "added_id", "feature"], "left")
    mine = mine.select("date", "added_id", F.col("added_id").alias("ticker_id"), "feature", F.when(F.col("x").isNotNull(), _scaled(1 + F.coalesce("__b", F.lit(0.0)), 1 + F.coalesce("__n", F.lit(0)))).alias("s"))
    return moved.unionByName(mine).groupBy("date", "added_id", "ticker_id").pivot("feature", features).agg(F.first("s"))


def _settled_below(stored: DataFrame, fresh: DataFrame, features: list[str], score: Callable[[DataFrame], DataFrame], reach: Mapping[str, float]) -> DataFrame:
    """date, added_id, __b (members below, ties by half; null without a score) and n_ranked, for each added name and date.

    An insertion moves a member's rank by 4 / (n - 2) at most, so its score by a small, known width.  Stored scores are dealt into bins
    that wide: members two bins below or above the name's score are counted by bin, those nearer are scored anew as inserted."""
    wide = lambda c, to: [F.max(F.when(F.col("feature") == f, F.col(c))).alias(f"{to}{f}") for f in features]
    some = lambda x: F.col(x).isNotNull().cast("int")

    def scored(df: DataFrame, values: dict, out: str) -> DataFrame:
        return score(df.select(F.struct("*").alias("__row"), "date", *(v.alias(f) for f, v in values.items()))).select("__row.*", F.col("score").cast("double").alias(out))

    # members by their values: those alike move alike
    members = stored.groupBy("date", "ticker_id").agg(*wide("v", "__v_"), *wide("place", "__p_"), *wide("n", "__m_"))
    alike = members.groupBy("date", *(f"{k}{f}" for k in ("__v_", "__p_", "__m_") for f in features)).agg(F.count("*").alias("__w"))
    as_stored = lambda v, p, n: {f: F.when(F.col(f"{v}{f}").isNotNull(), _scaled(F.col(f"{p}{f}"), F.col(f"{n}{f}"))) for f in features}
    alike = scored(alike, as_stored("__v_", "__p_", "__m_"), "__s0").filter("__s0 is not null")
    moves = sum((reach[f] * F.when(F.max(f"__m_{f}") > 2, F.least(F.lit(2.0), 4 / (F.max(f"__m_{f}") - 2))).otherwise(2.0) for f in features), F.lit(SLACK))
    dates = F.broadcast(alike.groupBy("date").agg(moves.alias("__d"), F.sum("__w").alias("__all")))  # at most the calendar
    bin_of = lambda s: F.floor(F.col(s) / F.col("__d"))
    alike = alike.join(dates.select("date", "__d"), "date").withColumn("__k", bin_of("__s0")).drop("__d", "__s0")

    # the added names, each with its own ranks and those of its old row
    values = stored.select("date", "feature", F.col("v").alias("x"), F.lit(None).cast(dict(fresh.dtypes)["ticker_id"]).alias("added_id"), F.lit(1).alias("__one"))
    new = _long(fresh, features, "x").withColumnRenamed("ticker_id", "added_id").distinct()
    by = Window.partitionBy("date", "feature", F.col("x").isNull())
    upto, ties = by.orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow), by.orderBy("x").rangeBetween(Window.currentRow, Window.currentRow)
    new = values.unionByName(new.withColumn("__one", F.lit(0)))
    new = new.withColumn("__below", F.sum("__one").over(upto) - F.sum("__one").over(ties) / 2).withColumn("__n", F.sum("__one").over(by)).filter("__one = 0").drop("__one")
    old = stored.select("date", "feature", F.col("ticker_id").alias("added_id"), F.col("v").alias("o"), F.col("place").alias("op"), F.col("n").alias("on"), F.lit(1).alias("had"))
    new = new.join(old, ["date", "feature", "added_id"], "left")
    passed = F.coalesce((F.col("o") < F.col("x")).cast("int") + 0.5 * (F.col("o") == F.col("x")).cast("int"), F.lit(0.0))
    new = new.withColumn("own", F.when(F.col("x").isNotNull(), _scaled(1 + F.col("__below") - passed, 1 + F.col("__n") - some("o"))))
    new = new.groupBy("date", "added_id").agg(*wide("x", "__x_"), *wide("own", "__own_"), *wide("o", "__o_"), *wide("op", "__op_"), *wide("on", "__on_"), F.max("had").alias("__had"))
    new = scored(scored(new, {f: F.col(f"__own_{f}") for f in features}, "__s"), as_stored("__o_", "__op_", "__on_"), "__s_old")
    new = new.withColumn("__s_old", F.when(F.col("__had") == 1, F.col("__s_old"))).join(dates, "date", "left").withColumn("__k", bin_of("__s")).withColumn("__k_old", bin_of("__s_old"))
    keys, at = ["date", "added_id"], [F.col(f"{k}{f}") for k in ("__x_", "__o_") for f in features]

    # members for certain below, by bins
    bins = alike.groupBy("date", "__k").agg(F.sum("__w").alias("__w"))
    probes = new.filter("__k is not null").select(*keys, (F.col("__k") - 2).alias("__k"), F.lit(0).cast("long").alias("__w"), (F.col("__k_old") <= F.col("__k") - 2).cast("int").alias("__less"))
    line = bins.select("date", F.lit(None).cast(dict(new.dtypes)["added_id"]).alias("added_id"), "__k", "__w", F.lit(None).cast("int").alias("__less")).unionByName(probes)
    far = line.withColumn("__far", F.sum("__w").over(Window.partitionBy("date").orderBy("__k").rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.coalesce("__less", F.lit(0))).filter("added_id is not null").select(*keys, "__far")

    # the others, as they are after the insertion
    above = lambda x, f: F.coalesce((F.col(f"{x}{f}") < F.col(f"__v_{f}")).cast("int") + 0.5 * (F.col(f"{x}{f}") == F.col(f"__v_{f}")).cast("int"), F.lit(0.0))
    near = new.select(*keys, "__s", "__had", *at, F.explode(F.array(F.col("__k") - 1, F.col("__k"), F.col("__k") + 1)).alias("__k")).filter("__k is not null").join(alike, ["date", "__k"])
    moved = {f: F.when(F.col(f"__v_{f}").isNotNull(), _scaled(F.col(f"__p_{f}") + above("__x_", f) - above("__o_", f), F.col(f"__m_{f}") + some(f"__x_{f}") - some(f"__o_{f}"))) for f in features}
    same = F.coalesce(F.col("__had"), F.lit(0))
    for f in features:  # the old row is one of these members
        same = same * F.col(f"__v_{f}").eqNullSafe(F.col(f"__o_{f}")).cast("int")
    near = scored(near.withColumn("__w", F.col("__w") - same), moved, "__s1")
    near = near.groupBy(*keys).agg(F.sum(F.col("__w") * ((F.col("__s1") < F.col("__s")).cast("int") + 0.5 * (F.col("__s1") == F.col("__s")).cast("int"))).alias("__near"))

    out = new.join(far, keys, "left").join(near, keys, "left")
    below = F.when(F.col("__s").isNotNull(), F.coalesce("__far", F.lit(0)) + F.coalesce("__near", F.lit(0.0)))
    return out.select(*keys, below.alias("__b"), (F.coalesce("__all", F.lit(0)) - some("__s_old") + some("__s")).cast("long").alias("n_ranked"))


def score_added(stored: DataFrame, asked: DataFrame, fresh: DataFrame, features: list[str], score: Callable[[DataFrame], DataFrame], reach: Mapping[str, float] | None = None) -> DataFrame:
    """ticker_id, date, relative_rank, n_ranked, status for each asked name (and date), each against the members and itself alone.

    ``score`` adds a column ``score`` to rows with the features.  The rank is the percentile of the name's score, ties averaged,
    0.5 for a name alone.  A name without fresh rows has ``insufficient_history`` and nulls.  Members' rows are never written.

    Without ``reach`` each added name is scored with all members, names x members rows.  ``reach`` says of each feature how much the score
    moves at most for one unit of it (the weights of a linear score); then only members that the name could pass are scored again, with the
    same results.  It asks that the score of a row depends on its features alone, and on whether they are null for being null."""
    fresh = fresh.join(asked.select("ticker_id").distinct(), "ticker_id", "left_semi")
    if reach is not None:
        return _with_status(asked, _settled_below(stored, fresh, features, score, reach))
    rows = score(inserted(stored, fresh, features))
    mine = rows.filter("ticker_id = added_id").select("date", "added_id", F.col("score").alias("__s"))
    place = (F.col("score") < F.col("__s")).cast("int") + 0.5 * (F.col("score") == F.col("__s")).cast("int")
    found = rows.join(mine, ["date", "added_id"]).groupBy("date", "added_id").agg((F.sum(place) - 0.5).alias("__b"), F.count("score").alias("n_ranked"))
    return _with_status(asked, found)


def _with_status(asked: DataFrame, found: DataFrame) -> DataFrame:
    found = found.select(F.col("added_id").alias("ticker_id"), "date", F.when(F.col("n_ranked") < 2, 0.5).otherwise(F.col("__b") / F.greatest(F.col("n_ranked") - 1, F.lit(1))).alias("relative_rank"), "n_ranked")
    out = asked.select("ticker_id").distinct().join(found, "ticker_id", "left")
    return out.withColumn("status", F.when(F.col("date").isNull(), "insufficient_history").otherwise("scored"))
