"""As-of joins: one union, one shuffle by key, one window; linear in both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_on: str,
    right_on: str,
    columns: list[str],
    tie: list[str] | None = None,
    per_column: bool = False,
    forward: bool = False,
    tolerance_days: int | None = None,
) -> DataFrame:
    """``left`` with ``columns`` of the latest ``right`` row at or before it (``forward``: first at or after).

    ``tie`` orders right rows of equal time, the last wins.  ``per_column``: each column is the latest
    non-null value of its own.  Beyond ``tolerance_days`` the row counts as missing.  Missing is null;
    right rows whose columns are all null still match.  Left columns must not clash with ``columns``.
    """
    return resolved(timeline(left, right, by, left_on, right_on, columns, tie, forward), by, columns, per_column, forward, tolerance_days)


def timeline(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, columns: list[str], tie: list[str] | None = None, forward: bool = False) -> DataFrame:
    """Both sides as rows of one table.  Stored in buckets by key, it is resolved any number of times without a shuffle."""
    both = F.struct(*(F.col(c) for c in columns), F.col(right_on).alias("__on"))
    tie = tie or []
    kinds = dict(right.dtypes)
    r = right.select(*by, F.col(right_on).alias("__ts"), F.lit(1 if forward else 0).alias("__side"), *(F.col(c).alias(f"__t{i}") for i, c in enumerate(tie)), both.alias("__r"), F.lit(None).cast(left.select(F.struct("*").alias("s")).dtypes[0][1]).alias("__l"))
    l = left.select(*by, F.col(left_on).alias("__ts"), F.lit(0 if forward else 1).alias("__side"), *(F.lit(None).cast(kinds[c]).alias(f"__t{i}") for i, c in enumerate(tie)), F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), F.struct(*(F.col(c) for c in left.columns)).alias("__l"))
    return l.unionByName(r)


def resolved(rows: DataFrame, by: list[str], columns: list[str], per_column: bool = False, forward: bool = False, tolerance_days: int | None = None) -> DataFrame:
    """The as-of join of a ``timeline``: one window by key."""
    ties = [c for c in rows.columns if c.startswith("__t") and c != "__ts"]
    w = Window.partitionBy(*by).orderBy("__ts", "__side", *ties)
    w = w.rowsBetween(0, Window.unboundedFollowing) if forward else w.rowsBetween(Window.unboundedPreceding, 0)
    pick = F.first if forward else F.last
    if per_column:
        rows = rows.select("*", *(pick(F.col("__r")[c], ignorenulls=True).over(w).alias(f"__c{i}") for i, c in enumerate(columns)))
        return rows.filter("__l is not null").select("__l.*", *(F.col(f"__c{i}").alias(c) for i, c in enumerate(columns)))
    rows = rows.withColumn("__m", pick("__r", ignorenulls=True).over(w)).filter("__l is not null")
    if tolerance_days is not None:
        rows = rows.withColumn("__m", F.when(F.abs(F.datediff(F.col("__ts"), F.col("__m")["__on"])) <= tolerance_days, F.col("__m")))
    return rows.select("__l.*", *(F.col("__m")[c].alias(c) for c in columns))


def lagged_asof(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, columns: list[str], lags: dict[str, int]) -> DataFrame:
    """Per-column as-of at ``left_on`` minus each lag in days; columns are suffixed by the lag's name.

    The probes of all lags go through one as-of join and are pivoted back."""
    keys = [*by, left_on]
    probes = left.select(*keys, F.explode(F.create_map(*(x for k, n in lags.items() for x in (F.lit(k), F.lit(n))))).alias("__lag", "__days")).distinct()
    probes = probes.withColumn("__at", F.date_sub(left_on, F.col("__days")))
    found = asof_join(probes, right, by, "__at", right_on, columns, per_column=True)
    wide = found.groupBy(*keys).agg(*(F.max(F.when(F.col("__lag") == k, F.col(c))).alias(f"{c}_{k}") for k in lags for c in columns))
    return left.join(wide, keys, "left")
