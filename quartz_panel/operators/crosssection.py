"""Cross-section transforms and targets over a panel (date, ticker_id, ...)."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut


def average_rank(value: str, *by: str) -> Column:
    """Rank from 1 with ties averaged; null values stay null and aren't ranked."""
    w = Window.partitionBy(*by, F.col(value).isNull()).orderBy(value)
    ties = F.count("*").over(w.rangeBetween(Window.currentRow, Window.currentRow))  # the rows of equal value, by the same shuffle and sort
    return F.when(F.col(value).isNotNull(), F.rank().over(w) + (ties - 1) / 2)


def counted(value: str, *by: str) -> Column:
    return F.count(value).over(Window.partitionBy(*by))


def rank01(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Percentile rank in [0, 1], ties averaged; 0.5 for a row alone."""
    n = counted(value, *by)
    return df.withColumn(out, F.when(F.col(value).isNotNull(), F.when(n < 2, 0.5).otherwise((average_rank(value, *by) - 1) / F.greatest(n - 1, F.lit(1)))))


def rank_normalize(panel: DataFrame, columns: list[str], relative: tuple[str, ...] = (), min_group: int = 5, relative_columns: tuple[str, ...] | None = None, then: tuple[Callable[[pa.Table], pa.Table], str] | None = None) -> DataFrame:
    """Each column ranked to [-1, 1] within a date, ties averaged; a name alone is 0.

    A date's rows meet in one task as they are, not melted, and each column is ranked there: one shuffle by date.  ``relative``
    groups (sector, then industry) of ``min_group`` names or more re-rank ``relative_columns`` (default: all) within (date, group).
    ``then``: a function of a date's ranked rows that appends columns, and their names and types."""
    others = [c for c in panel.columns if c not in ("date", "ticker_id", *columns)]
    rows = panel.filter("date is not null and ticker_id is not null").select("date", "ticker_id", *others, *(F.col(c).cast("double") for c in columns))
    anew = set(columns if relative_columns is None else relative_columns)

    def ranked(frame: pa.Table) -> pa.Table:
        codes = [pc.dictionary_encode(frame[g].combine_chunks(), "mask").indices.fill_null(-1).to_numpy(zero_copy_only=False) for g in relative]
        for c in columns:
            there = frame[c].is_valid().to_numpy()
            v = _scaled_ranks(frame[c].drop_null().to_numpy(), np.zeros(int(there.sum()), "int32"))[0]
            for code in (codes if c in anew else ()):
                g = code[there]
                scaled, n = _scaled_ranks(v, g)
                v = np.where((g >= 0) & (n >= min_group), scaled, v)
            out = np.zeros(len(there))
            out[there] = v
            frame = frame.set_column(frame.column_names.index(c), c, pa.array(out, mask=~there))
        return then[0](frame) if then else frame

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + (f", {then[1]}" if then else "")
    return rows.groupBy("date").applyInArrow(ranked, kinds)


def _scaled_ranks(x: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each value its rank in [-1, 1] within its group, ties averaged (NaN is the largest and ties with itself), and the group's size."""
    order = np.lexsort((x, group))
    xs, gs = x[order], group[order]
    first = np.ones(len(x), bool)  # of its group
    first[1:] = gs[1:] != gs[:-1]
    new = first.copy()  # first of its ties
    new[1:] |= (xs[1:] != xs[:-1]) & ~(np.isnan(xs[1:]) & np.isnan(xs[:-1]))
    begin, tied = np.flatnonzero(first), np.flatnonzero(new)
    size = np.diff(np.append(begin, len(x)))
    n, start = np.repeat(size, size), np.repeat(begin, size)
    ties = np.diff(np.append(tied, len(x)))
    rank = (np.repeat(tied, ties) - start + 1) + (np.repeat(ties, ties) - 1) / 2
    scaled, sizes = np.empty(len(x)), np.empty(len(x), "int64")
    scaled[order] = np.where(n < 2, 0.0, 2 * (rank - 1) / np.maximum(n - 1, 1) - 1)
    sizes[order] = n
    return scaled, sizes


def date_columns(frame: pa.Table, medians: Mapping, horizons: tuple[str, ...], targets: Mapping[str, str], digits: int | None = None) -> pa.Table:
    """One date's ranked rows with what ``demean``, ``knife_score`` and the targets say, for ``rank_normalize``'s ``then``: no shuffle of its own.

    ``medians``: by (date, horizon).  ``targets``: rank or sector_return by horizon, as label_h.  ``digits``: to round returns to before labels are made."""
    day = frame["date"][0].as_py()
    made, add = {}, {}
    for h in horizons:
        median = medians.get((day, h))
        ok = frame[f"mask_{h}"].fill_null(False).to_numpy() & (median is not None)
        r = np.where(ok, frame[f"r_{h}"].to_numpy() - (median or 0.0), 0.0)
        if digits is not None:
            r = _half_up(r, digits)
        made |= {f"r_{h}": r, f"mask_{h}": ok}
        add[f"y_{h}"] = pa.array(ok & (r > 0))
    v, t, low = (((frame[c].to_numpy()) + 1) / 2 for c in ("vol_120d", "ma_gap_200", "dist_low_252"))
    down = 1 - (t + low) / 2
    knife = v * down
    median = np.median(knife[~np.isnan(knife)]) if (~np.isnan(knife)).any() else 0.5
    for c, x, none in (("vol_p", v, 0.5), ("downtrend_p", down, 0.5), ("knife_score", knife, median)):
        add[c] = pa.array(np.where(np.isnan(x), none, x))
    for h, mode in targets.items():
        r, ok = made[f"r_{h}"], made[f"mask_{h}"]
        y = np.full(len(r), np.nan)
        if mode == "rank":
            y[ok] = _average_ranks(r[ok]) / ok.sum()
        else:
            y[ok] = r[ok]
            codes = pc.dictionary_encode(frame["sector"].combine_chunks(), "mask").indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for g in np.unique(codes[codes >= 0]):
                mine = ok & (codes == g)
                if mine.sum() >= 5:
                    y[mine] = r[mine] - np.median(r[mine])
        add[f"label_{h}"] = pa.array(y, from_pandas=True)
    for c, x in made.items():
        frame = frame.set_column(frame.column_names.index(c), frame.schema.field(c), pa.array(x))
    for c, x in add.items():
        frame = frame.append_column(c, x)
    return frame


def _average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties averaged."""
    xs = np.sort(x)
    return (np.searchsorted(xs, x, "left") + np.searchsorted(xs, x, "right") + 1) / 2


def _half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded after scaling, halves away from 0; -0.0 becomes 0.0."""
    scaled = x * 10.0**digits
    low = np.floor(np.abs(scaled))
    return np.copysign(low + (np.abs(scaled) - low >= 0.5), scaled) / 10.0**digits + 0.0


def demean(panel: DataFrame, medians: DataFrame, horizon: str) -> DataFrame:
    """r_h minus the date's median; without a median masked, with r 0.  medians: date, median."""
    r, mask = f"r_{horizon}", f"mask_{horizon}"
    j = panel.join(F.broadcast(medians.select("date", "median")), "date", "left")
    ok = F.col(mask) & F.col("median").isNotNull()
    return j.withColumn(r, F.when(ok, F.col(r) - F.col("median")).otherwise(0.0)).withColumn(mask, ok).withColumn(f"y_{horizon}", ok & (F.col(r) > 0)).drop("median")


def group_median_gap(panel: DataFrame, value: str, group: str, out: str, min_group: int = 5, valid: Column | None = None, by_join: bool = False) -> DataFrame:
    """``value`` minus its (date, group) median where the group isn't null and has ``min_group`` valid rows; else unchanged.

    ``by_join``: the medians come from an aggregation (a row a date and group), not a window, so the wide rows of a stored panel stay where they are."""
    v = F.when(valid, F.col(value)) if valid is not None else F.col(value)
    if by_join:
        medians = cut(panel.filter(F.col(group).isNotNull()).groupBy("date", group).agg(F.count(v).alias("__n"), F.median(v).alias("__median")).filter(F.col("__n") >= min_group).drop("__n"))
        gap = F.when(F.col("__found"), F.col(value) - F.col("__median")).otherwise(F.col(value))
        return panel.join(F.broadcast(medians.withColumn("__found", F.lit(True))), ["date", group], "left").withColumn(out, gap).drop("__median", "__found")
    w = Window.partitionBy("date", group)
    return panel.withColumn(out, F.when(F.col(group).isNotNull() & (F.count(v).over(w) >= min_group), F.col(value) - F.median(v).over(w)).otherwise(F.col(value)))


def knife_score(panel: DataFrame, vol="vol_120d", trend="ma_gap_200", dlow="dist_low_252", ranked: bool = False, by_join: bool = False) -> DataFrame:
    """Adds vol_p (percentile of volatility), downtrend_p (1 - mean percentile of trend and distance to the low) and knife_score, their product.

    A null product takes the date's median product, then 0.5; null parts are 0.5 afterwards.  ``ranked``: the columns are ranks in [-1, 1] already.
    ``by_join``: the medians come from an aggregation (a row a date), not a window, for a stored panel whose wide rows should stay where they are.
    Without one of the columns all three are 0.5."""
    if not {vol, trend, dlow} <= set(panel.columns):
        return panel.withColumns(dict.fromkeys(("vol_p", "downtrend_p", "knife_score"), F.lit(0.5)))
    df = panel
    for c, p in ((vol, "__v"), (trend, "__t"), (dlow, "__l")):
        df = df.withColumn(p, (F.col(c) + 1) / 2) if ranked else rank01(df, ["date"], c, p)
    df = df.withColumn("vol_p", F.col("__v")).withColumn("downtrend_p", 1 - (F.col("__t") + F.col("__l")) / 2)
    df = df.withColumn("knife_score", F.col("vol_p") * F.col("downtrend_p")).drop("__v", "__t", "__l")
    if by_join:
        medians = df.groupBy("date").agg(F.median("knife_score").alias("__median"))
        df = df.join(F.broadcast(medians), "date", "left")
        return df.withColumn("knife_score", F.coalesce("knife_score", "__median", F.lit(0.5))).drop("__median").fillna(0.5, ["vol_p", "downtrend_p"])
    median = F.median("knife_score").over(Window.partitionBy("date"))
    return df.withColumn("knife_score", F.coalesce("knife_score", median, F.lit(0.5))).fillna(0.5, ["vol_p", "downtrend_p"])


def knife_tier(vol_p="vol_p", downtrend_p="downtrend_p", high: float = 0.8, mid: float = 0.6) -> Column:
    """high or elevated where both the volatility and the down-trend percentile reach the mark."""
    both = F.least(vol_p, downtrend_p)
    return F.when(both >= high, "high").when(both >= mid, "elevated").otherwise("none")


def knife_overlay(df: DataFrame, by: list[str], rank: str, knife: str, weight: float, out: str) -> DataFrame:
    """rank01 of (1 - weight) * rank - weight * rank01(knife); a weight of 0 or less changes nothing."""
    if weight <= 0:
        return df.withColumn(out, F.col(rank))
    df = rank01(df, by, knife, "__k").withColumn("__b", (1 - weight) * F.col(rank) - weight * F.col("__k"))
    return rank01(df, by, "__b", out).drop("__k", "__b")


def target_rank(panel: DataFrame, horizon: str) -> DataFrame:
    """y_rank: percentile of average ranks over unmasked rows, (0, 1]."""
    v = panel.withColumn("__v", F.when(F.col(f"mask_{horizon}"), F.col(f"r_{horizon}")))
    return v.withColumn("y_rank", average_rank("__v", "date") / counted("__v", "date")).drop("__v")


def target_quantile(panel: DataFrame, horizon: str, buckets: int = 5) -> DataFrame:
    """y_quantile: equal-count bucket from 0; null for fewer rows than buckets; equal edges merge."""
    v = panel.withColumn("__v", F.when(F.col(f"mask_{horizon}"), F.col(f"r_{horizon}") + 0.0))
    w = Window.partitionBy("date")
    edges = F.array_distinct(F.percentile("__v", F.array(*(F.lit(i / buckets) for i in range(buckets + 1)))).over(w))
    v = v.withColumn("__e", edges).withColumn("__n", F.count("__v").over(w))
    bucket = F.greatest(F.size(F.filter("__e", lambda e: e < F.col("__v"))) - 1, F.lit(0))
    return v.withColumn("y_quantile", F.when((F.col("__n") >= buckets) & F.col("__v").isNotNull(), bucket)).drop("__v", "__e", "__n")


def target_sector_return(panel: DataFrame, horizon: str, out: str = "y_sector_return", value: str | None = None) -> DataFrame:
    return group_median_gap(panel, value or f"r_{horizon}", "sector", out, 5, F.col(f"mask_{horizon}"))


def target_sector_return_vol(panel: DataFrame, horizon: str, vol: str = "vol_120d") -> DataFrame:
    """Sector-relative return over max(vol, the date's 20th percentile of vol), at least 1e-4; null where vol is."""
    floor = F.percentile(vol, F.lit(0.2)).over(Window.partitionBy("date"))
    df = target_sector_return(panel, horizon, "__s").withColumn("__f", floor)
    return df.withColumn("y_sector_return_vol", F.when(F.col(vol).isNotNull(), F.col("__s") / F.greatest(F.col(vol), F.col("__f"), F.lit(1e-4)))).drop("__s", "__f")


def target_beta_resid(panel: DataFrame, market_r: DataFrame, horizon: str, sector: bool = False) -> DataFrame:
    """r - beta * market return over the horizon, null where that is missing; ``sector``: minus its sector median."""
    m = market_r.filter(F.col("horizon") == horizon).select("date", "market_r")
    df = panel.join(F.broadcast(m), "date", "left").withColumn("y_beta_resid", F.when(F.col(f"mask_{horizon}"), F.col(f"r_{horizon}") - F.col("beta_252d") * F.col("market_r"))).drop("market_r")
    return group_median_gap(df, "y_beta_resid", "sector", "y_beta_sector_resid", 5) if sector else df


def date_percentile(panel: DataFrame, column: str, q: float) -> DataFrame:
    return panel.groupBy("date").agg(F.percentile(column, F.lit(q)).alias("value"))


def blend_ranks(df: DataFrame, by: list[str], a: str, b: str, weight: float, out: str) -> DataFrame:
    """(1 - weight) * rank01(a) + weight * rank01(b); a weight of 0 or less gives ``a`` itself."""
    if weight <= 0:
        return df.withColumn(out, F.col(a))
    df = rank01(rank01(df, by, a, "__a"), by, b, "__b")
    return df.withColumn(out, (1 - weight) * F.col("__a") + weight * F.col("__b")).drop("__a", "__b")
