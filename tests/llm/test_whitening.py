"""Whitening against dense eigenvectors, exact sums, and vectors that can't be fitted."""

import math

import numpy as np
import pytest

from tracegrid.llm import whitening as W

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def dense(x, k):
    """Eigenvalues, vectors and mean of the distinct rows' covariance matrix."""
    u = np.unique(x, axis=0)
    c = u - u.mean(axis=0)
    values, vectors = np.linalg.eigh(c.T @ c / len(u))
    return values[::-1][:k], vectors[:, ::-1][:, :k], u


@pytest.mark.parametrize("dims,k", [(1, 16), (5, 16), (64, 16), (200, 10)])
def test_solver_against_dense(dims, k):
    rng = np.random.default_rng(dims)
    a = rng.normal(size=(3 * dims, dims)) * rng.uniform(0.1, 3, dims)
    v = a.T @ a / len(a)
    used = []
    values, vectors, residual = W.leading(lambda b: used.append(b.shape[1]) or v @ b, dims, k)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:k], rtol=1e-13, atol=0)
    assert residual <= 64 * W.EPS and np.abs(v @ vectors - vectors * values).max() < 1e-12 * values[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12 and len(used) < 130


def test_minres_solves_the_projected_equation():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(40, 40))
    v = a @ a.T
    held = np.linalg.qr(rng.normal(size=(40, 4)))[0]
    r = rng.normal(size=(40, 3))
    r -= held @ (held.T @ r)
    theta = np.array([500.0, 600.0, 1000.0])
    t = W._corrections(lambda b: v @ b, theta, held, r, 200, 1e-12)
    p = np.eye(40) - held @ held.T
    for i in range(3):
        assert np.abs(p @ (v @ t[:, i] - theta[i] * t[:, i]) + r[:, i]).max() < 1e-8
    assert np.abs(held.T @ t).max() < 1e-10


def test_query_against_dense(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = {r.vec_id: np.array([math.floor(64 * float(c)) + 1_000_000 for c in r.embedding]) for r in rows if r.embedding and all(c is not None and math.isfinite(c) for c in r.embedding)}
    values, vectors, u = dense(np.array(list(x.values())), 16)
    n, sums = len(u), [int(s) for s in u.sum(axis=0)]
    trace = ((u - u.mean(axis=0)) ** 2).sum() / n
    got = W.op12_whitening(spark, SF).collect()
    assert len(got) == 16 * len(x)
    signs = {}
    for r in got:
        c = r.component - 1
        want = (x[r.vec_id] - u.mean(axis=0)) @ vectors[:, c] / math.sqrt(values[c])
        sign = signs.setdefault(c, 1 if (r.whitened > 0) == (want > 0) else -1)
        assert abs(sign * r.whitened - want) < 1e-7 and abs(r.explained / (values[c] / trace) - 1) < 1e-9
        assert r.n == n and r.identity_error < 1e-9
        assert r.deviation == sum((n * int(a) - s) ** 2 for a, s in zip(x[r.vec_id], sums))


def test_rows_that_cannot_be_fitted(spark):
    rng = np.random.default_rng(3)
    fine = [(i, [float(a) for a in rng.normal(size=3)]) for i in range(20)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, NAN, 2.0]), (104, [INF, 0.0, 0.0]), (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0]), (None, fine[0][1]), (7, fine[7][1]), (108, fine[3][1])]
    df = spark.createDataFrame([(i, v, 1, "z") for i, v in fine + odd], "vec_id long, `a.b` array<double>, x int, id string")
    rows = W.usable(df, "vec_id", "a.b")
    w = W.fit(rows)
    got = W.whiten(rows, w, "vec_id").collect()
    assert w.n == 20 and len(w.values) == 3 and len(got) == 3 * 23
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append((r.component, r.deviation, r.whitened))
    assert by[None] == by[0] and len(by[7]) == 6 and by[108] == by[3] and 105 not in by
    for none in (df.where("false"), df.where("vec_id = 1"), df.where("vec_id in (0) or vec_id is null"), df.where("vec_id between 100 and 104")):
        some = W.usable(none, "vec_id", "a.b")
        assert W.whiten(some, W.fit(some)).count() == 0
    flat = spark.createDataFrame([(i, [float(a), float(a), 5.0]) for i, a in enumerate(range(6))], "id long, v array<double>")
    some = W.usable(flat, "id", "v")
    assert W.whiten(some, W.fit(some)).count() == 6


def test_partial_sums_and_long_deviations(spark, monkeypatch):
    df = spark.createDataFrame([(i, [i, -i, 2 * i]) for i in range(50)], "id long, x array<long>").repartition(7)
    rows = W.gathered(df)
    plain = rows.products(np.eye(3))
    monkeypatch.setattr(W, "AT_ONCE", 1)
    rows.tasks = 7
    assert np.allclose(rows.products(np.eye(3)), plain) and rows.sums == [1225, -1225, 2450]
    x = np.array([[1 << 40, 0], [5, 1]])
    assert W.deviations(x, 10, [0, 0]) == [None, 2600]
