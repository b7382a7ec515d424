"""Production models: one ridge a horizon by its specification, fitted together; scores of the current cross-section.

A specification is a mapping with features, window (latest dates of training, None: all), knife_lambda and span."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import evaluate as E
from . import gram as G
from .crosssection import knife_overlay, knife_tier, rank01

MODELS = "horizon string, intercept double, coefficients array<double>"


def training_rows(panel: DataFrame, specs: Mapping[str, Mapping], as_of, label: Mapping[str, str], excluded: DataFrame | None = None) -> DataFrame:
    """horizon, date, ticker_id, y and the feature values x (those of all specifications): labelled rows before ``as_of`` in each horizon's window.

    Names of ``excluded`` (ticker_id, user-added ones) aren't trained on.  Dates are counted by horizon, over the rows that are left."""
    names = all_features(specs)
    parts = F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(label[h]).cast("double").alias("y"), F.lit(specs[h].get("window")).cast("int").alias("window")) for h in specs))
    rows = panel.filter(F.col("date") < as_of)
    if excluded is not None:
        rows = rows.join(excluded.select("ticker_id").distinct(), "ticker_id", "left_anti")
    rows = rows.select("date", "ticker_id", G._values(names).alias("x"), F.explode(parts).alias("p")).select("date", "ticker_id", "x", "p.*").filter(F.col("y").isNotNull() & ~F.isnan("y"))
    dates = rows.select("horizon", "window", "date").distinct()  # at most the calendar
    latest = F.row_number().over(Window.partitionBy("horizon").orderBy(F.desc("date")))
    kept = dates.withColumn("k", latest).filter(F.col("window").isNull() | (F.col("k") <= F.col("window"))).select("horizon", "date")
    return rows.drop("window").join(F.broadcast(kept), ["horizon", "date"], "left_semi")


def all_features(specs: Mapping[str, Mapping]) -> list[str]:
    """The features of all specifications, doubles dropped, order kept."""
    return list(dict.fromkeys(c for s in specs.values() for c in s["features"]))


def train_windows(rows: DataFrame) -> DataFrame:
    """horizon, start, end, n_rows and names of the rows that a horizon is trained on."""
    return E.window_facts(rows, "horizon")


def fit_horizons(rows: DataFrame, specs: Mapping[str, Mapping], alpha: float = 10.0) -> DataFrame:
    """horizon, intercept, coefficients (in the order of the horizon's features): ridge fits from one aggregation over ``training_rows``.

    A horizon's features are rows and columns of the common Gram matrix; a horizon without rows gives no model."""
    names = all_features(specs)
    places = {h: [0, *(names.index(c) + 1 for c in s["features"]), len(names) + 1] for h, s in specs.items()}

    def product(x, y):
        z = np.column_stack([np.ones(len(x)), x, y])
        return z.T @ z

    def solved(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        at = places[key[0]]
        g = np.stack(frame.sort_values("i")["values"].to_numpy())[np.ix_(at, at)]
        _, side, solve = G._solver(pd.DataFrame({"i": range(len(at)), "values": list(g)}))
        return pd.DataFrame([(key[0], *solve(side, alpha))], columns=["horizon", "intercept", "coefficients"])

    sums = G._summed(rows.select("horizon", "x", "y"), ["horizon"], product, len(names) + 2)
    return sums.groupBy("horizon").applyInPandas(solved, MODELS)


def score_horizons(current: DataFrame, models: DataFrame, specs: Mapping[str, Mapping], prior: DataFrame | None = None, second: DataFrame | None = None, weight: float = 0.0) -> DataFrame:
    """date, ticker_id, horizon, raw_rank, rank and tier of each row of ``current`` (one date) and each horizon that has a model.

    The model's score may be blended by rank with ``second`` (horizon, ticker_id, pred).  The rank takes the knife overlay of the
    specification, then a step from the last stored rank (``prior``: ticker_id, horizon, prior_rank) where it has a span; a
    name without a stored rank keeps its own before the new ranking.  A name alone has 0.5.  Scores are rounded to nine digits."""
    out = None
    for h, spec in specs.items():
        mine = F.broadcast(models.filter(F.col("horizon") == h))
        pred = F.col("intercept") + F.aggregate(F.zip_with(G._values(list(spec["features"])), "coefficients", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        rows = current.crossJoin(mine).withColumn("pred", F.round(pred, 9)).drop("intercept", "coefficients")  # one model
        if second is not None:
            rows = G.blended(rows, rows.select("date", "ticker_id").join(second.filter(F.col("horizon") == h).select("ticker_id", "pred"), "ticker_id"), weight)
        rows = rank01(rows, ["date"], "pred", "raw_rank").withColumn("knife_score", F.round("knife_score", 9))
        rows = overlaid(rows, spec.get("knife_lambda", 0.0)).select("date", "ticker_id", "horizon", "raw_rank", "rank", knife_tier(F.round("vol_p", 9), F.round("downtrend_p", 9)).alias("tier"))
        if prior is not None and spec.get("span", 0) > 0:
            rows = E.smooth_to_prior(rows, prior, spec["span"])
        part = rows.select("date", "ticker_id", "horizon", "raw_rank", "rank", "tier")
        out = part if out is None else out.unionByName(part)
    return out


def overlaid(rows: DataFrame, weight: float) -> DataFrame:
    """``rank``: raw_rank after the knife overlay, its blend rounded to nine digits before it is ranked."""
    if weight <= 0:
        return knife_overlay(rows, ["date"], "raw_rank", "knife_score", 0.0, "rank")
    rows = rank01(rows, ["date"], "knife_score", "__k").withColumn("__b", F.round((1 - weight) * F.col("raw_rank") - weight * F.col("__k"), 9))
    return rank01(rows, ["date"], "__b", "rank").drop("__k", "__b")
