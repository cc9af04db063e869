"""Rank-one updates against plain eigendecompositions, and whitening against exact covariances."""

import numpy as np
import pytest

from motionlake.llm import whitening


def test_rank_one_updates_with_deflation():
    rng = np.random.default_rng(0)
    for trial in range(100):
        d = int(rng.integers(1, 20))
        rows = rng.standard_normal((int(rng.integers(1, 3 * d + 2)), d)) * 10.0 ** rng.integers(-4, 5)
        rows = (rows, np.repeat(rows, 3, axis=0), np.round(rows), rows * (np.arange(d) % 2), np.vstack([3 * np.eye(d), 3 * np.eye(d), rows]))[trial % 5]
        values, vectors = np.zeros(d), np.eye(d)
        for v in rows:
            values, vectors = whitening.rank_one(values, vectors, v)
        want = rows.T @ rows
        assert np.abs(vectors * values @ vectors.T - want).max() <= 1e-11 * max(np.abs(want).max(), 1e-300)
        assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-11 and (np.diff(values) >= 0).all()
        values, vectors = whitening.absorb(np.zeros(d), np.eye(d), rows)
        assert np.abs(vectors * values @ vectors.T - want).max() <= 1e-11 * max(np.abs(want).max(), 1e-300)


def expected(x):
    """whitened, deviation and explained from covariances in whole numbers."""
    n, s = len(x), x.sum(axis=0)
    d = (n * x - s).astype(object)
    v = np.array(d.T @ d / n**3, float)
    e, u = np.linalg.eigh(v)
    at = np.argsort(-e)[:8]
    return np.array((n * x - s) / n) @ u[:, at] / np.sqrt(e[at]), (d * d).sum(axis=1), e[at] / e.sum()


@pytest.mark.parametrize("parts", [1, 40])
def test_against_exact_covariance(spark, parts):
    """Forty tasks join in two levels; a third of the rows is one vector."""
    rng = np.random.default_rng(1)
    v = (rng.standard_normal((600, 12)) * np.linspace(1, 3, 12)).astype(np.float32)
    v[:200] = v[0]
    rows = [(i, x.tolist(), 1, 0.5) for i, x in enumerate(v)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component int, whitened double").repartition(parts)
    got = whitening.whiten(table).toPandas()
    white, deviation, explained = expected(np.floor(1024 * v.astype(float)).astype(np.int64) + 100_000)
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(w * np.sign((w * white).sum(axis=0)) - white).max() < 1e-9
    assert (got[got.component == 1].sort_values("vec_id").deviation.to_numpy() == deviation).all()
    assert np.allclose(got.groupby("component").explained.first(), explained, rtol=1e-10) and (got.groupby("component").explained.nunique() == 1).all()
    assert got.identity_error.max() < 1e-9 and (got.n == 600).all() and len(got) == 4800


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (None, [1.0]), (3, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (3, [None, 1.0]), (4, []), (4, []), (5, [1e30, -1e30])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(table).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted((i, c) for i in (0, 1, 4, 4, 5) for c in (1, 2)) and {r.n for r in got} == {5}
    assert {r.deviation for r in got} == {None}  # beyond a long
    small = whitening.whiten(table.filter("vec_id = 1 OR vec_id IS NULL")).collect()
    assert {(r.vec_id, r.component, r.deviation, round(abs(r.whitened), 9)) for r in small} == {(1, 1, 2048**2, 1.0), (None, 1, 2048**2, 1.0), (1, 2, 2048**2, 0.0), (None, 2, 2048**2, 0.0)}
    one = whitening.whiten(table.filter("vec_id = 1")).collect()
    assert [(r.deviation, r.whitened, r.explained) for r in one] == [(0, 0.0, 0.0)] * 2
    assert whitening.whiten(table.limit(0)).count() == 0 and whitening.whiten(table.filter("vec_id = 4")).count() == 0
