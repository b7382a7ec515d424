"""Embedding whitening: principal components of the vectors' covariance by contour integration (FEAST), and scores of unit covariance.

Spark sums counts, integer sums and then centred products, a row for each entry of the covariance and task.  The covariance V, whose
size depends on a vector's width alone, is cut on the driver into eigenvalue intervals: the inertia of V - sI (negative pivots of
the tridiagonal form) counts the eigenvalues below any s.  Each interval is a Spark task.  It integrates (zI - V)^-1 Y over a circle
around the interval by Gauss-Legendre nodes, complex shifted solves that project Y onto the interval's eigenvectors;
Rayleigh-Ritz extracts them, and the number found must be the inertia count, or else the subspace grows and it goes on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch

#: An entry c becomes floor(64 * c) + 1000000.
SCALE, SHIFT = 64, 1_000_000
#: Entries from here on have no place in a long; their rows count as not finite.
TOO_LARGE = float(1 << 54)
#: Nodes on the half circle, eigenvalues of an interval at most (ties of more stay together), rounds before a subspace grows.
NODES, MOST_INSIDE, ROUNDS = 8, 8, 6


class Fit(NamedTuple):
    """n rows of ``dims`` entries with integer ``sums``, and the components as columns of ``vectors`` by falling eigenvalue."""

    n: int
    dims: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray


def integer_rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors: rows of the batch and their integer vectors.  Null vectors, null, non-finite and huge entries drop a row."""
    column = batch.column(batch.schema.get_field_index("v"))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])
    with np.errstate(invalid="ignore"):
        bad = np.concatenate([[0], np.cumsum(~(np.abs(values) < TOO_LARGE))])
    good = (lengths >= 0) & (bad[starts[1:]] == bad[starts[:-1]])
    for d in np.unique(lengths[good]):
        rows = np.flatnonzero(good & (lengths == d))
        yield rows, np.floor(values[starts[rows][:, None] + np.arange(d)] * SCALE).astype(np.int64) + SHIFT


def _exact_sums(x: np.ndarray) -> list[int]:
    if not x.size or int(np.abs(x).max()) * len(x) < 1 << 62:
        return x.sum(0).tolist()
    return x.astype(object).sum(0).tolist()


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: dict[int, int] = {}
    s: dict[int, list[int]] = {}
    for batch in batches:
        for rows, x in integer_rows(batch):
            d = x.shape[1]
            n[d] = n.get(d, 0) + len(rows)
            s[d] = [a + b for a, b in zip(s.get(d, [0] * d), _exact_sums(x), strict=True)]
    where = [(d, i) for d in n for i in range(-1, d)]
    yield pa.RecordBatch.from_arrays(
        [pa.array([d for d, _ in where], pa.int32()), pa.array([i for _, i in where], pa.int32()), pa.array([Decimal(n[d] if i < 0 else s[d][i]) for d, i in where], pa.decimal128(38, 0))], names=["dims", "i", "s"]
    )


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n: the whole part is taken off as integers, so nothing is lost by cancellation."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole).astype(np.float64) - np.array([(s % n) / n for s in sums])


def _triangle(m: np.ndarray) -> pa.RecordBatch:
    i, j = np.triu_indices(len(m))
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(m[i, j], pa.float64())], names=["i", "j", "g"])


def _products(rows: DataFrame, n: int, sums: list[int], basis: np.ndarray | None = None) -> np.ndarray:
    """Sum of outer products of the centred rows, or of their projections on ``basis``, over all rows; entries are added up by Spark."""
    dims, size = len(sums), len(sums) if basis is None else basis.shape[1]

    def partial(batches):
        total = np.zeros((size, size))
        for batch in batches:
            for _, x in integer_rows(batch):
                if x.shape[1] == dims:
                    y = centred(x, n, sums)
                    y = y if basis is None else y @ basis
                    total += y.T @ y
        yield _triangle(total)

    out = np.zeros((size, size))
    for r in rows.mapInArrow(partial, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.g
    return out


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and side diagonal of a matrix similar to symmetric ``v``, by reflections."""
    a = v.copy()
    for k in range(len(a) - 2):
        u = a[k + 1 :, k].copy()
        norm = np.linalg.norm(u)
        u[0] += math.copysign(norm, u[0])
        if (size := np.linalg.norm(u)) == 0:
            continue
        u /= size
        p = a[k + 1 :, k + 1 :] @ u
        p -= (u @ p) * u
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(u, p) + np.outer(p, u))
        a[k + 1, k] = -math.copysign(norm, a[k + 1, k])
    return np.diag(a).copy(), np.diag(a, -1).copy()


def below(diagonal: np.ndarray, side: np.ndarray, shift: float) -> int:
    """Eigenvalues under ``shift``: negative pivots, by Sylvester's law of inertia."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    count, pivot = 0, 1.0
    for k in range(len(diagonal)):
        pivot = diagonal[k] - shift - (side[k - 1] ** 2 / pivot if k else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        count += pivot < 0
    return int(count)


def intervals(v: np.ndarray, wanted: int, most: int = MOST_INSIDE) -> tuple[list[tuple[float, float, int]], int]:
    """(low, high, eigenvalues between) from the top down, until ``wanted`` are covered; and how many there are above rounding.

    Edges lie where no eigenvalue is near; what can't be parted so, ties say, stays in one interval."""
    diagonal, side = tridiagonal(v)
    norm = float(np.abs(v).sum(1).max())
    floor, top, d = 8 * len(v) * np.finfo(float).eps * norm, norm * 1.01, len(v)
    count = lambda s: below(diagonal, side, s)
    able = d - count(floor)
    todo, out, have = [(floor, top, d - able, d)], [], 0
    while todo and have < min(wanted, able):
        low, high, under_low, under_high = todo.pop()
        inside = under_high - under_low
        if not inside:
            continue
        middle = None
        if inside > most:
            for part in (0.5, 0.44, 0.56, 0.37, 0.63, 0.3, 0.7):
                s, gap = low + part * (high - low), 1e-3 * (high - low)
                if gap > floor and count(s - gap) == count(s + gap):
                    middle = s
                    break
            else:
                if high - low > 1e6 * floor:  # crowded everywhere: the edge has less room
                    s, gap = low + 0.5 * (high - low), 4 * floor
                    middle = s if count(s - gap) == count(s + gap) else None
        if middle is None:
            out.append((float(low), float(high), int(inside)))
            have += inside
        else:
            k = count(middle)
            todo += [(low, middle, under_low, k), (middle, high, k, under_high)]
    return out, able


def contour(v: np.ndarray, low: float, high: float, inside: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``inside`` eigenvalues between ``low`` and ``high`` and their unit vectors."""
    d, centre, radius = len(v), (low + high) / 2, (high - low) / 2
    x, w = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(-0.5j * np.pi * (x - 1))
    norm, room = np.linalg.norm(v), min(d, max(inside + 8, inside * 3 // 2))
    rng = np.random.default_rng(seed)
    y, found = rng.standard_normal((d, room)), None
    for k in range(1 << 30):
        q = sum(w[j] / 2 * (radius * turn[j] * np.linalg.solve((centre + radius * turn[j]) * np.eye(d) - v, y)).real for j in range(NODES))
        q = np.linalg.qr(q)[0]
        values, rotation = np.linalg.eigh(q.T @ v @ q)
        y = q @ rotation
        error = np.linalg.norm(v @ y - y * values, axis=0)
        ours = (values > low) & (values < high) & (error < 1e-6 * norm)
        if ours.sum() == inside:
            last, found = found, float(error[ours].max())
            if found <= 4 * np.finfo(float).eps * norm or last is not None and found > last / 2:  # as exact as doubles allow
                return values[ours], y[:, ours]
        if (k + 1) % ROUNDS == 0 and ours.sum() != inside:  # one was missed
            if room == d:
                raise ArithmeticError(f"{ours.sum()} of {inside} eigenvalues found between {low} and {high}")
            room = min(d, 2 * room)
            y, found = np.hstack([y, rng.standard_normal((d, room - y.shape[1]))]), None


def components(rows: DataFrame, v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues above rounding and their vectors; each interval is solved in a task of its own."""
    parts, able = intervals(v, wanted)
    d, spark = len(v), rows.sparkSession
    if not parts:
        return np.zeros(0), np.zeros((d, 0))
    shared = spark.sparkContext.broadcast(v)

    def solve(batches):
        for batch in batches:
            for p in batch.to_pylist():
                e, x = contour(shared.value, p["low"], p["high"], p["inside"])
                yield pa.RecordBatch.from_arrays([pa.array(e, pa.float64()), pa.array(x.T.tolist(), pa.list_(pa.float64()))], names=["e", "x"])

    table = spark.createDataFrame(parts, "low double, high double, inside int").repartition(len(parts), "low")
    got = table.mapInArrow(solve, "e double, x array<double>").collect()
    keep = min(wanted, able)
    if len(got) != sum(k for _, _, k in parts) or len(got) < keep:
        raise ArithmeticError("the components found aren't as many as the inertia counts")
    e, x = united(v, np.array([r.x for r in got]).T)
    e, x = e[:keep], x[:, :keep]
    return e, x * np.sign(x[np.abs(x).argmax(0), np.arange(keep)])


def united(v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz over the vectors of all intervals, by falling eigenvalue: those of neighbouring intervals become orthogonal to rounding."""
    q = np.linalg.qr(x)[0]
    e, rotation = np.linalg.eigh(q.T @ v @ q)
    return e[::-1], (q @ rotation)[:, ::-1]


def fit(vectors: DataFrame, column: str = "embedding", wanted: int = 32) -> Fit | None:
    """Mean and components of the vectors of the most frequent length (the longer of two); None without a vector.

    Three passes over the table; nothing that grows with it reaches the driver."""
    rows, scratch = vectors.select(F.col(f"`{column}`").alias("v")), Scratch(vectors.sparkSession)
    totals = scratch.written(rows.mapInArrow(_sums, "dims int, i int, s decimal(38,0)").groupBy("dims", "i").agg(F.sum("s").alias("s")), "vector-sums")
    most = totals.filter("i = -1").orderBy(F.desc("s"), F.desc("dims")).first()
    sums = [int(r.s) for r in totals.filter(F.col("dims") == most.dims).filter("i >= 0").orderBy("i").collect()] if most else []
    scratch.drop(totals)
    if not most:
        return None
    n, v = int(most.s), np.zeros((0, 0))
    if sums:
        v = _products(rows, n, sums) / n
    e, x = components(rows, v, wanted) if len(v) and np.trace(v) > 0 else (np.zeros(0), np.zeros((len(sums), 0)))
    return Fit(n, most.dims, sums, float(np.trace(v)), e, x)


def whiten(vectors: DataFrame, model: Fit, column: str = "embedding", id: str = "vec_id") -> DataFrame:
    """id, deviation and whitened (an array, a score for each component), a row for each vector of the fitted length.

    deviation is the exact sum over the entries of (n * x - S)^2; null where that has no place in a long."""
    n, sums, basis = model.n, model.sums, model.vectors / np.sqrt(model.values)
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)

    def scores(batches):
        for batch in batches:
            for rows, x in integer_rows(batch):
                if x.shape[1] == model.dims:
                    gap = x - whole
                    if gap.size and (n * int(np.abs(gap).max()) + n) ** 2 * model.dims >= 1 << 63:
                        exact = ((gap.astype(object) * n - rest.astype(object)) ** 2).sum(1).tolist()
                        deviation = pa.array([a if a < 1 << 63 else None for a in exact], pa.int64())
                    else:
                        deviation = pa.array(((gap * n - rest) ** 2).sum(1), pa.int64())
                    w = np.ascontiguousarray(centred(x, n, sums) @ basis)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), deviation, lists], names=["id", "deviation", "whitened"])

    kind = vectors.schema[id].dataType.simpleString()
    out = vectors.select(F.col(f"`{id}`").alias("id"), F.col(f"`{column}`").alias("v")).mapInArrow(scores, f"id {kind}, deviation long, whitened array<double>")
    return out.withColumnRenamed("id", id)


def identity_error(vectors: DataFrame, model: Fit, column: str = "embedding") -> float:
    """Largest absolute entry of the scores' covariance, over all rows, minus the identity."""
    if not len(model.values):
        return 0.0
    c = _products(vectors.select(F.col(f"`{column}`").alias("v")), model.n, model.sums, model.vectors / np.sqrt(model.values)) / model.n
    return float(np.abs(c - np.eye(len(c))).max())


def whitened_components(vectors: DataFrame, wanted: int = 32, column: str = "embedding", id: str = "vec_id") -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained and identity_error: a row for each vector and component.

    Rows drop whose vector is null, holds a null, NaN, infinite or huge (2**54 or more) entry, or hasn't the most frequent length.
    Components without variance can't be scaled to one and are left out, so equal vectors, a single one, empty vectors or an empty
    table give no rows.  Tied eigenvalues have vectors of their common space.  Repeated rows and ids count and return each time; other columns are ignored."""
    model, schema = fit(vectors, column, wanted), f"{id} {vectors.schema[id].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    explained = F.array(*(F.lit(float(e / model.trace)) for e in model.values))
    return whiten(vectors, model, column, id).select(id, "deviation", F.posexplode("whitened").alias("i", "whitened")).select(
        id, (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("i")).alias("explained"), F.lit(identity_error(vectors, model, column)).alias("identity_error")
    )
