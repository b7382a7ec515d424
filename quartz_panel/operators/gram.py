"""Walk-forward ridge models without a fit per fold.

One aggregation gives each date's Gram matrix of (1, features, label).  Cumulated over dates, the matrix of any training window is a
difference of two; one eigendecomposition of its centred part serves all penalties and all right-hand sides, such as those of
permuted labels.  Sizes: dates x features^2, whatever the number of rows; folds and dates are bounded by the calendar."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import evaluate as E
from .crosssection import rank01
from .cut import cut

#: Keys (date, or seed and date) whose sums a task holds before it hands them on.
HELD = 512

MODELS = "test_date date, alpha double, n_train long, intercept double, coefficients array<double>"
PERMUTED = "seed int, test_date date, intercept double, coefficients array<double>"


def _values(features: list[str]):
    return F.array(*(F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(0.0)) for c in features))


def _labelled(panel: DataFrame, label: str) -> DataFrame:
    return panel.filter(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double")))


def _summed(rows: DataFrame, keys: list[str], product, size: int) -> DataFrame:
    """keys, i, values: the sum of ``product(x, y)`` (a matrix of ``size`` columns) over the rows of a key; partial sums in each task, added up by Spark."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def flush(held: dict) -> pd.DataFrame:
        out = [(*(k if isinstance(k, tuple) else (k,)), i, m[i].tolist()) for k, m in held.items() for i in range(len(m))]
        return pd.DataFrame(out, columns=[*keys, "i", "values"])

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for frame in frames:
            for k, part in frame.groupby(keys if len(keys) > 1 else keys[0], sort=False):
                m = product(np.stack(part["x"].to_numpy()), part["y"].to_numpy())
                held[k] = held[k] + m if k in held else m
            if len(held) > HELD:
                yield flush(held)
                held = {}
        yield flush(held)

    parts = rows.mapInPandas(partial, f"{kinds}, i int, values array<double>")
    return parts.groupBy(*keys, "i").agg(F.array(*(F.sum(F.col("values")[j]) for j in range(size))).alias("values"))


def date_grams(panel: DataFrame, features: list[str], label: str) -> DataFrame:
    """date, i, values: row i of Z'Z by date, Z = (1, features, label) over labelled rows; a missing feature is 0."""

    def product(x, y):
        z = np.column_stack([np.ones(len(x)), x, y])
        return z.T @ z

    return _summed(_labelled(panel, label).select("date", _values(features).alias("x"), F.col(label).cast("double").alias("y")), ["date"], product, len(features) + 2)


def permuted_moments(panel: DataFrame, features: list[str], label: str, seeds: list[int]) -> DataFrame:
    """seed, date, i, values: the label's sum and its products with the features, labels dealt anew within each date.

    The order of a deal is that of md5("seed:date:ticker_id"), all seeds in one shuffle; only labels are repeated for the seeds until the join."""
    rows = _labelled(panel, label)
    a = rows.select("date", _values(features).alias("x"), F.row_number().over(Window.partitionBy("date").orderBy("ticker_id")).alias("k"))
    b = rows.select("date", "ticker_id", F.col(label).cast("double").alias("y"), F.explode(F.array(*map(F.lit, seeds))).alias("seed"))
    order = Window.partitionBy("seed", "date").orderBy(F.md5(F.concat_ws(":", "seed", F.date_format("date", "yyyy-MM-dd"), "ticker_id")), "ticker_id")
    dealt = a.join(b.select("seed", "date", "y", F.row_number().over(order).alias("k")), ["date", "k"]).select("seed", "date", "x", "y")
    return _summed(dealt, ["seed", "date"], lambda x, y: np.concatenate([[y.sum()], x.T @ y])[None, :], len(features) + 1)


def _windows(sums: DataFrame, keys: list[str], folds: list) -> DataFrame:
    """keys, test_date, values: ``values`` summed over each fold's training dates, as a difference of cumulated sums."""
    kinds = ", ".join(f"{k} {sums.schema[k].dataType.simpleString()}" for k in keys)
    tests, cutoffs, lowers = [f.test_date for f in folds], [f.cutoff for f in folds], [f.lower for f in folds]

    def differences(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("date")
        total = np.vstack([np.zeros(len(frame["values"].iloc[0])), np.cumsum(np.stack(frame["values"].to_numpy()), axis=0)])
        dates = frame["date"].to_numpy()
        upto, before = np.searchsorted(dates, cutoffs, "right"), np.searchsorted(dates, lowers, "left")
        out = pd.DataFrame({k: [v] * len(tests) for k, v in zip(keys, key, strict=True)})
        return out.assign(test_date=tests, values=list(total[upto] - total[before]))

    return sums.groupBy(*keys).applyInPandas(differences, f"{kinds}, test_date date, values array<double>")


def _solver(frame: pd.DataFrame):
    """Of a fold's Gram matrix: rows, own right-hand side, and the function from (side, penalty) to intercept and coefficients."""
    g = np.stack(frame.sort_values("i")["values"].to_numpy())
    n, means = g[0, 0], g[0, 1:-1] / max(g[0, 0], 1.0)
    e, q = np.linalg.eigh(g[1:-1, 1:-1] - n * np.outer(means, means))
    e = np.maximum(e, 0.0)

    def solve(side: np.ndarray, alpha: float) -> tuple[float, list[float]]:
        total, products = side[0], side[1:]
        bent, scale = q.T @ (products - means * total), e + alpha
        w = q @ np.where(scale > 1e-12 * max(e.max(initial=0.0), 1e-300), bent / np.maximum(scale, 1e-300), 0.0)
        return float(total / max(n, 1.0) - means @ w), w.tolist()

    return int(round(n)), g[:-1, -1], solve


def folds_of(panel: DataFrame, horizon_bars: int, min_train: int = 36, window: int | None = None) -> list:
    """The folds as rows (test_date, cutoff, lower): at most one for each date of the calendar."""
    return sorted(E.walk_forward_folds(panel.select("date"), horizon_bars, min_train, window).collect())


def ridge_folds(panel: DataFrame, features: list[str], label: str, folds: list, alphas: tuple[float, ...] = (10.0,)) -> DataFrame:
    """test_date, alpha, n_train, intercept, coefficients: ridge over each fold's window, for each penalty; folds without a labelled row give none."""

    def solved(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        n, side, solve = _solver(frame)
        rows = [(key[0], float(a), n, *solve(side, a)) for a in alphas] if n else []
        return pd.DataFrame(rows, columns=["test_date", "alpha", "n_train", "intercept", "coefficients"])

    if not folds:
        return panel.sparkSession.createDataFrame([], MODELS)
    windows = _windows(date_grams(panel, features, label), ["i"], folds)
    return windows.groupBy("test_date").applyInPandas(solved, MODELS)


def permuted_folds(panel: DataFrame, features: list[str], label: str, folds: list, seeds: list[int], alpha: float = 10.0) -> DataFrame:
    """seed, test_date, intercept, coefficients of labels permuted within dates: each fold is decomposed once for all seeds."""

    def solved(key: tuple, grams: pd.DataFrame, sides: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(grams):
            n, _, solve = _solver(grams)
            rows = [(int(s.seed), key[0], *solve(np.asarray(s.values_), alpha)) for s in sides.rename(columns={"values": "values_"}).itertuples()] if n else []
        return pd.DataFrame(rows, columns=["seed", "test_date", "intercept", "coefficients"])

    if not folds:
        return panel.sparkSession.createDataFrame([], PERMUTED)
    grams = _windows(date_grams(panel, features, label), ["i"], folds)
    sides = _windows(permuted_moments(panel, features, label, seeds), ["seed", "i"], folds)
    return grams.groupBy("test_date").cogroup(sides.groupBy("test_date")).applyInPandas(solved, PERMUTED)


def scored(panel: DataFrame, features: list[str], models: DataFrame, out: str = "pred") -> DataFrame:
    """Rows of the test dates with ``out`` for each model of their date; the models are one row a date, penalty and seed."""
    x, w = _values(features), F.col("coefficients")
    fitted = F.broadcast(models.withColumnRenamed("test_date", "date"))
    pred = F.col("intercept") + F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return panel.join(fitted, "date").withColumn(out, F.round(pred, 9)).drop("intercept", "coefficients")


def walk_forward_ranks(pred: DataFrame, r: str, min_names: int = 30, knife_lambda: float = 0.0, span: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """Test rows with raw_rank, rank (after the knife overlay, then smoothing over a name's dates) and r; dates without a rank correlation are left out.

    Scores are rounded to nine digits before they are ranked, so that equal ones tie whatever the order of a sum.  The rows are cut
    from their lineage before and after, as they are read several times."""
    keys = [*by, "date"]
    p = cut(pred.withColumn("r", F.col(r)))
    p = p.join(E.rank_ic(p, min_names, tuple(keys)).select(*keys), keys, "left_semi")
    p = rank01(p, keys, "pred", "raw_rank").withColumn("__r", F.col("raw_rank"))
    if knife_lambda > 0:
        p = rank01(p, keys, "knife_score", "__k").withColumn("__b", F.round((1 - knife_lambda) * F.col("__r") - knife_lambda * F.col("__k"), 9))
        p = rank01(p.drop("__r"), keys, "__b", "__r").drop("__k", "__b")
    if span > 0:
        smooth = E.ewma_rank(p.select(*by, "ticker_id", "date", F.col("__r").alias("rank")), span, (*by, "ticker_id")).withColumn("smooth", F.round("smooth", 9))
        return cut(p.drop("__r").join(smooth.select(*keys, "ticker_id", F.col("smooth").alias("rank")), [*keys, "ticker_id"]))
    return cut(p.withColumnRenamed("__r", "rank"))


def walk_forward_summary(ranks: DataFrame, by: tuple[str, ...] = (), min_group: int = 10, min_names: int = 30) -> DataFrame:
    """by, n, mean, std, icir, t, hit_rate, sector_ic and its icir, turnover_raw and turnover (of the final ranks)."""
    keys = (*by, "date")
    universe = E.ic_summary(E.rank_ic(ranks, min_names, keys, "rank"), *by)
    sector = E.within_group_ic(ranks.withColumn("pred", F.col("rank")), "sector", min_group, keys).groupBy(*by).agg(F.avg("ic").alias("sector_ic"), F.try_divide(F.avg("ic"), F.stddev_samp("ic")).alias("sector_icir"))
    raw = E.rank_turnover(ranks, "raw_rank", by).withColumnRenamed("turnover", "turnover_raw")
    parts = [sector, raw, E.rank_turnover(ranks, "rank", by)]
    for part in parts:
        universe = universe.join(part, list(by), "left") if by else universe.crossJoin(part)  # one row each without ``by``
    return universe


def blended(a: DataFrame, b: DataFrame, weight: float) -> DataFrame:
    """``a`` with pred as (1 - weight) of its rank and weight of ``b``'s rank of the same date and name; a name missing in ``b`` keeps its own."""
    if weight <= 0:
        return a
    x = rank01(a, ["date"], "pred", "__a").drop("pred")
    y = rank01(b.select("date", "ticker_id", "pred"), ["date"], "pred", "__b").drop("pred")
    mixed = F.round((1 - weight) * F.col("__a") + weight * F.coalesce("__b", "__a"), 9)
    return x.join(y, ["date", "ticker_id"], "left").withColumn("pred", mixed).drop("__a", "__b")


def null_verdict(real: DataFrame, null: DataFrame) -> DataFrame:
    """One row: reps, real, null_mean, null_std, z and verdict of the mean IC against the means of permuted labels.

    real: ics of the model; null: ics with a column seed."""
    means = null.groupBy("seed").agg(F.avg("ic").alias("m"))
    stats = means.agg(F.count("m").alias("reps"), F.avg("m").alias("null_mean"), F.stddev_samp("m").alias("null_std"))
    z = F.when(F.col("null_std") > 0, (F.col("real") - F.col("null_mean")) / F.col("null_std"))
    out = real.agg(F.avg("ic").alias("real")).crossJoin(stats).withColumn("z", z)  # one row each
    return out.withColumn("verdict", F.when(F.col("z").isNull(), "undecided").when(F.col("z") > 2, "beyond the null").otherwise("within the null"))


__all__ = ["blended", "date_grams", "folds_of", "null_verdict", "permuted_folds", "permuted_moments", "ridge_folds", "scored", "walk_forward_ranks", "walk_forward_summary"]
