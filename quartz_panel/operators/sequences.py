"""Assembly of sequence windows: fixed-length arrays of what was known at each bar."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import fundamentals as U
from . import price as P
from . import sentiment as N
from .asof import asof_join

#: Windows that a task holds at once.
BLOCK = 256


def _windowed(rows: DataFrame, length: int, first: int, stride: int, out: list[str], make: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], kind: str = "array<double>") -> DataFrame:
    """ticker_id, trade_date and the columns ``out`` for each window of ``length`` rows that ends at pos ``first``, or a multiple of ``stride`` after it.

    A name's rows meet in one task once, in order of their pos, and windows are views of them, a block at a time.  ``make`` gets the windows of
    each other column (windows x length) and gives ``out``: arrays of windows x length, or for the kind double one value a window.  A null is
    NaN there and in what is made of it; masked entries become null."""
    names = [c for c in rows.columns if c not in ("ticker_id", "trade_date", "pos")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks().sort_by("pos")
        held = {c: np.ma.masked_array(table[c].to_numpy(), mask=table[c].is_null().to_numpy()) if table[c].null_count else table[c].to_numpy() for c in names}
        for at in range(first, len(table), stride * BLOCK):
            ends = np.arange(at, min(len(table), at + stride * BLOCK), stride)
            view = lambda x: sliding_window_view(x, length)[at - length + 1 : ends[-1] - length + 2 : stride]  # noqa: E731, B023
            made = make({c: np.ma.masked_array(view(x.data), mask=view(x.mask)) if isinstance(x, np.ma.MaskedArray) else view(x) for c, x in held.items()})
            columns = []
            for c in out:
                values = made[c].ravel()
                values = pa.array(np.ma.getdata(values), pa.float64(), mask=np.ma.getmaskarray(values) if isinstance(values, np.ma.MaskedArray) else None)
                columns.append(values if kind == "double" else pa.ListArray.from_arrays(np.arange(0, len(values) + 1, length, dtype="int32"), values))
            keys = table.select(["ticker_id", "trade_date"]).take(ends)
            yield pa.RecordBatch.from_arrays([*(keys[c].combine_chunks() for c in keys.column_names), *columns], names=[*keys.column_names, *out])

    types = dict(rows.dtypes)
    return rows.groupBy("ticker_id").applyInArrow(run, f"ticker_id {types['ticker_id']}, trade_date {types['trade_date']}, " + ", ".join(f"{c} {kind}" for c in out))


def _zscores(x: np.ndarray) -> np.ndarray:
    """Rows less their mean, over their population deviation; zeros where that is below 1e-9, null where a value is null."""
    if isinstance(x, np.ma.MaskedArray):
        x = np.ma.masked_array(x.data, mask=np.broadcast_to(x.mask.any(1, keepdims=True), x.shape))
    centred = x - np.ma.getdata(x).mean(1, keepdims=True)
    deviation = np.sqrt((np.ma.getdata(centred) ** 2).mean(1))
    flat = deviation < 1e-9
    out = centred / np.where(flat, 1.0, deviation)[:, None]
    out[flat] = 0.0
    return out


def _closes(bars: DataFrame) -> DataFrame:
    """Adds pos and c, the last close above 0 up to the bar."""
    return P.bar_index(bars).withColumn("c", F.last(F.when(F.col("adj_close") > 0, F.col("adj_close")), ignorenulls=True).over(P.by_ticker().rowsBetween(Window.unboundedPreceding, 0)))


def sequence_windows(bars: DataFrame, stride: int) -> DataFrame:
    """ticker_id, trade_date, returns (252 log returns), z (their z-scores), volumes (z of log volume, null or 0 as 1): for strided end rows only.

    A price gap takes the close before it."""
    b = _closes(bars).select("ticker_id", "trade_date", "pos", F.ln(F.col("c") / F.lag("c").over(P.by_ticker())).alias("r"), F.ln(F.when(F.col("volume") > 0, F.col("volume")).otherwise(1.0)).alias("v"))
    return _windowed(b, 252, 252, stride, ["returns", "z", "volumes"], lambda w: {"returns": w["r"], "z": _zscores(w["r"]), "volumes": _zscores(w["v"])})


#: The columns of a sequence sample, in the order of the network's input.
RATIOS = ["revenue_growth", "gross_margin", "operating_margin", "debt_equity", "fcf_revenue"]
SAMPLE_COLUMNS = ["return_z", "volume_z", "volatility", "sentiment_7d", "sentiment_14d", *RATIOS, "day_sin", "day_cos"]


def sequence_samples(bars: DataFrame, filings: DataFrame, daily: DataFrame, stride: int = 1, summary: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """ticker_id, trade_date and the 12 columns of the 252-bar window ending there, an array each; by default for every end row.

    What depends on the bar alone is found once for each bar: its return, its filing as known then, its sentiment (rolled
    daily rows, carried 3 days), its season.  The 20-row deviation is cut at the window's start.  A price gap takes the close before it.
    ``summary`` takes a column's windows (windows x 252) where they are made and gives one value for each instead, so that what
    a reader doesn't keep of them, 24 kB a window, needn't leave the task."""
    b = N.filled(bars, daily, "trade_date")
    b = asof_join(b, U.annotated(filings), ["ticker_id"], "trade_date", "filed_at", RATIOS, tie=["accession_number"]).fillna(0.0, RATIOS)
    angle = F.lit(2 * math.pi / 365.25) * F.dayofyear("trade_date")
    b = _closes(b).withColumn("r", F.coalesce(F.ln(F.col("c") / F.lag("c").over(P.by_ticker())), F.lit(0.0))).withColumn("v", F.ln(F.greatest(F.coalesce("volume", F.lit(1.0)), F.lit(1.0))))
    b = b.withColumn("volatility", F.stddev_pop("r").over(P.rows(20))).withColumn("day_sin", F.sin(angle)).withColumn("day_cos", F.cos(angle)).select("ticker_id", "trade_date", "pos", "r", "v", *SAMPLE_COLUMNS[2:])

    places = np.arange(1, 20)

    def sample(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        r = w["r"][:, :19]
        mean = np.cumsum(r, 1) / places
        short = np.sqrt(np.stack([((r[:, :i] - mean[:, i - 1 : i]) ** 2).mean(1) for i in range(1, 20)], 1))
        made = w | {"return_z": _zscores(w["r"]), "volume_z": _zscores(w["v"]), "volatility": np.concatenate([short, w["volatility"][:, 19:]], 1)}
        return made if summary is None else {c: summary(made[c]) for c in SAMPLE_COLUMNS}

    return _windowed(b, 252, 252, stride, SAMPLE_COLUMNS, sample, "array<double>" if summary is None else "double")
