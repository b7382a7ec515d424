"""Whitening against exact sums and numpy's own decomposition; contour solves on spectra with ties, clusters and missing ranks."""

import math

import numpy as np
import pytest

from quartz_panel.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, component string, v int, i int"


def spectrum(kind: str, d: int, rng) -> np.ndarray:
    return {"spread": rng.random(d) * 100, "ties": rng.integers(1, 4, d).astype(float), "rank": np.r_[rng.random(5), np.zeros(d - 5)], "wide": 10.0 ** rng.uniform(-9, 3, d)}[kind]


@pytest.mark.parametrize(("kind", "d"), [("spread", 64), ("spread", 1), ("ties", 64), ("ties", 90), ("rank", 40), ("wide", 48)])
def test_intervals_hold_all_components(kind, d):
    rng = np.random.default_rng(d)
    e = spectrum(kind, max(d, 6), rng)[:d]
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    parts, able = W.intervals(v, 32)
    assert able == (5 if kind == "rank" else d)
    found = [W.contour(v, *p) for p in parts]
    n = min(32, able)
    assert [len(a) for a, _ in found] == [k for *_, k in parts] and sum(len(a) for a, _ in found) >= n
    values, x = W.united(v, np.hstack([x for _, x in found]))
    values, x, norm = values[:n], x[:, :n], np.linalg.norm(v)
    assert np.allclose(values, np.sort(e)[::-1][:n], atol=1e-13 * norm, rtol=0)
    assert np.abs(v @ x - x * values).max() < 1e-13 * norm
    assert np.abs(x.T @ x - np.eye(n)).max() < 1e-13


def test_inertia_counts_eigenvalues_below():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((30, 30))
    v = a + a.T
    diagonal, side = W.tridiagonal(v)
    e = np.linalg.eigvalsh(v)
    for s in [*(e[:-1] + e[1:]) / 2, -99.0, 99.0]:
        assert W.below(diagonal, side, s) == (e < s).sum()


def brute(vectors: dict[int, list[float]]) -> tuple[dict, np.ndarray, float]:
    x = {k: [math.floor(64 * c) + 1000000 for c in v] for k, v in vectors.items()}
    n, d = len(x), len(next(iter(x.values())))
    s = [sum(v[i] for v in x.values()) for i in range(d)]
    y = np.array([[(n * v[i] - s[i]) / n for i in range(d)] for v in x.values()])
    e, q = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-e)[:32]
    white = y @ q[:, order] / np.sqrt(e[order])
    return {k: (sum((n * v[i] - s[i]) ** 2 for i in range(d)), white[m]) for m, (k, v) in enumerate(x.items())}, e[order] / e.sum(), n


def test_query_columns_equal_brute_force(spark):
    from quartz_panel.llm import queries as Q

    d = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    want, explained, n = brute({r.vec_id: list(r.embedding) for r in table})
    got = Q.op12_whitening(spark, d).collect()
    assert len(got) == 32 * len(want) and {r.component for r in got} == set(range(1, 33))
    signs = {k: np.sign(next(r.whitened * want[r.vec_id][1][k - 1] for r in got if r.component == k and abs(r.whitened) > 0.5)) for k in range(1, 33)}
    for r in got:
        assert r.n == n and r.deviation == want[r.vec_id][0]
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        assert r.whitened == pytest.approx(signs[r.component] * want[r.vec_id][1][r.component - 1], abs=1e-7)
        assert 0 <= r.identity_error < 1e-9


def test_rows_that_drop_and_clashing_columns(spark):
    rng = np.random.default_rng(5)
    good = {k: rng.standard_normal(4).tolist() for k in range(40)}
    bad = [None, [1.0, None, 2.0, 3.0], [1.0, math.nan, 2.0, 3.0], [1.0, math.inf, 2.0, 3.0], [1.0], [], [1e300, 0.0, 0.0, 0.0]]
    rows = [(k, v) for k, v in good.items()] + [(100 + k, v) for k, v in enumerate(bad)] + [(None, good[0])]
    table = spark.createDataFrame([(k, v, "x", 1, 2) for k, v in rows], SCHEMA).repartition(3)
    got = W.whitened_components(table).collect()
    want, explained, _ = brute({**good, -1: good[0]})
    assert len(got) == 4 * 41 and {r.n for r in got} == {41}
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.component, r.deviation) for r in got) == sorted((k, c, want[k][0]) for k in want for c in range(1, 5))
    assert sum({r.component: r.explained for r in got}.values()) == pytest.approx(1.0)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(k, [3.0, 4.0]) for k in range(5)], [(1, None), (2, [])]])
def test_without_variance_no_rows(spark, rows):
    assert W.whitened_components(spark.createDataFrame([(k, v, "", 0, 0) for k, v in rows], SCHEMA)).collect() == []


def test_missing_rank_and_large_values(spark):
    rows = [(k, [k * 1e13, -k * 1e13, 0.0, 5.0]) for k in range(-20, 20)]
    got = W.whitened_components(spark.createDataFrame([(k, v, "", 0, 0) for k, v in rows], SCHEMA)).collect()
    want, _, n = brute(dict(rows))
    assert {r.component for r in got} == {1} and len(got) == n
    assert all(r.deviation == (want[r.vec_id][0] if want[r.vec_id][0] < 1 << 63 else None) for r in got)
    assert abs(sum(r.whitened for r in got)) < 1e-6 and sum(r.whitened**2 for r in got) / n == pytest.approx(1.0)
