"""Whitening against a plain eigendecomposition."""

import math

import numpy as np
import pytest

from heliopanel.llm import whitening as W


def matrices(n):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n))
    q, _ = np.linalg.qr(a)
    yield a @ a.T
    yield np.diag(np.arange(n) ** 4.0)
    yield np.eye(n) * 3
    yield np.outer(a[0], a[0])
    yield q @ np.diag([5.0] * (n // 2) + [1.0] * (n - n // 2)) @ q.T
    yield np.zeros((n, n))
    yield a @ a.T * 1e-12 + np.diag([1e6] + [0.0] * (n - 1))


@pytest.mark.parametrize("n", [1, 2, 3, 8, 64])
def test_components_are_eigenvectors(n):
    for a in matrices(n):
        a = (a + a.T) / 2
        k = min(4, n)
        values, vectors = W.components_of(a, 4)
        want = np.linalg.eigvalsh(a)[::-1][:k]
        size = max(np.abs(want).max(), 1e-300)
        assert np.abs(values - want).max() <= 1e-12 * size
        assert np.linalg.norm(a @ vectors - vectors * values) <= 1e-11 * size
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12


def test_polar_factor_is_orthogonal():
    a = np.random.default_rng(3).normal(size=(20, 20))
    a = a + a.T
    u = W.polar(a)
    assert np.abs(u @ u - np.eye(20)).max() < 1e-13
    assert np.linalg.eigvalsh(u @ a).min() > 0  # the other factor is positive


SCHEMA = "vec_id long, embedding array<float>"


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) * 0.1).astype(np.float32)
    rows = [(i, [float(v) for v in vectors[i % 250]]) for i in range(300)] + [(900, None), (901, [1.0] * 5 + [None]), (902, [math.nan] * 6), (903, [math.inf] * 6)]
    got = W.whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert len(got) == 300 * 4 and list(got.columns) == ["vec_id", *W.OUTPUT]
    x = np.floor(256 * vectors.astype(np.float64)).astype(np.int64)
    fit = np.unique(x[:250], axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    covariance = centred.T @ centred / n
    values, vecs = np.linalg.eigh(covariance)
    values, vecs = values[::-1], vecs[:, ::-1]
    assert set(got["n"]) == {n} and got["identity_error"].iloc[0] < 1e-9
    for component, part in got.sort_values("vec_id").groupby("component"):
        z = (x[np.arange(300) % 250] - sums / n) @ vecs[:, component - 1] / np.sqrt(values[component - 1])
        ours = part["whitened"].to_numpy()
        assert min(np.abs(ours - z).max(), np.abs(ours + z).max()) < 1e-9
        assert abs(part["explained"].iloc[0] / (values[component - 1] / np.trace(covariance)) - 1) < 1e-12
        assert part["deviation"].tolist() == [int(sum((n * int(v) - int(s)) ** 2 for v, s in zip(x[i % 250], sums))) for i in range(300)]


def test_odd_vectors(spark):
    def run(rows, schema=SCHEMA):
        return W.whiten(spark.createDataFrame(rows, schema)).orderBy("vec_id", "component").collect()

    assert run([]) == [] and run([(1, None), (2, [])]) == []
    same = run([(1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [0.5, 0.25])])
    assert len(same) == 6 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.n == 1 for r in same)
    flat = run([(1, [0.0, 0.0, 1.0]), (2, [0.0, 0.0, -1.0])])
    assert [r.component for r in flat] == [1, 2, 3] * 2 and [abs(r.whitened) if r.whitened is not None else None for r in flat] == [1.0, None, None] * 2
    mixed = run([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [3.0]), (4, [4.0])])
    assert [(r.vec_id, r.component, r.n) for r in mixed] == [(1, 1, 2), (1, 2, 2), (2, 1, 2), (2, 2, 2), (3, 1, 2), (4, 1, 2)]
    assert run([(1, [-0.0, 1e-30]), (2, [0.0, -1e-30])])[0].n == 2
    huge = run([(1, [3e38]), (2, [-3e38])])
    assert [r.deviation for r in huge] == [None, None] and abs(huge[0].whitened) == 1.0
    more = W.whiten(spark.createDataFrame([(1, [0.5], 7, "a"), (2, [1.5], 8, "b")], "vec_id long, embedding array<double>, n int, row string"))
    assert more.columns == ["vec_id", "row", *W.OUTPUT] and more.where("n = 2").count() == 2
    assert W.whiten(spark.createDataFrame([([0.5],)], "embedding array<double>")).columns == list(W.OUTPUT)


def test_deviation_uses_exact_numbers():
    x = np.array([[1 << 40, -(1 << 40)], [3, 4]], np.int64)
    assert W.deviations(x, 1, [0, 0]) == [None, 25]
    assert W.deviations(x[1:], 10, [1, 2]) == [29 ** 2 + 38 ** 2]
