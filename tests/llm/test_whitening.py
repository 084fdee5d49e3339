"""Whitening against a dense eigensolver, and its defined cases."""

import math

import numpy as np
import pytest
from codestrata.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, component string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, "a", "b") for i, v in rows], schema)


def dense(vectors):
    """n, sums, eigenvalues and vectors, exact deviations and x of each row."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    distinct = np.array(sorted(set(map(tuple, x))), dtype=float)
    c = distinct - distinct.mean(axis=0)
    e, u = np.linalg.eigh(c.T @ c / len(c))
    ints = [list(map(int, r)) for r in set(map(tuple, x))]
    sums = [sum(col) for col in zip(*ints, strict=True)]
    return x, len(distinct), sums, e[::-1], u[:, ::-1]


def compare(spark, vectors):
    rows = whitening.components_of(frame(spark, list(enumerate(vectors)))).collect()
    x, n, sums, e, u = dense(vectors)
    of = {(r.vec_id, r.component): r for r in rows}
    m = len({r.component for r in rows})
    assert len(rows) == len(of) == m * len(vectors)
    got = np.array([[of[i, k + 1].whitened for k in range(m)] for i in range(len(vectors))])
    want = (np.array(x, dtype=float) - np.array(sums) / n) @ u[:, :m] / np.sqrt(e[:m])
    for k in range(m):
        sign = np.sign(got[:, k] @ want[:, k])
        assert np.allclose(got[:, k] * sign, want[:, k], atol=1e-6)
    for r in rows:
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x[r.vec_id], sums, strict=True))
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9) and r.identity_error < 1e-8
    return m


def test_equals_a_dense_solver(spark):
    v = np.random.default_rng(1).normal(size=(300, 20)) @ np.random.default_rng(2).normal(size=(20, 20))
    assert compare(spark, v.tolist()) == 16


def test_repeats_count_once_in_the_fit(spark):
    v = np.random.default_rng(3).normal(size=(40, 5)).tolist()
    assert compare(spark, v + [v[0]] * 200) == 5


def test_fewer_components_than_asked(spark):
    assert compare(spark, [[float(i), 2.0 * i, -float(i), 1.0] for i in range(9)]) == 1
    assert whitening.components_of(frame(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.0])])).count() == 0
    assert whitening.components_of(frame(spark, [])).count() == 0
    assert whitening.components_of(frame(spark, [(0, None), (1, [])])).count() == 0


def test_rows_that_go(spark):
    v = np.random.default_rng(4).normal(size=(30, 3)).tolist()
    bad = [None, [1.0, None, 2.0], [1.0, float("nan"), 0.0], [float("inf"), 0.0, 0.0], [1e30, 0.0, 0.0], [1.0, 2.0], []]
    d = whitening.components_of(frame(spark, [*enumerate(v), *((100 + i, b) for i, b in enumerate(bad)), (None, v[0])]))
    rows = d.collect()
    assert {r.vec_id for r in rows} == {*range(30), None} and rows[0].n == 30 and len(rows) == 93
    assert [f.dataType.simpleString() for f in d.schema] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]


def test_wide_entries_stay_exact(spark):
    v = [[1.5e4 * i, float(i % 3)] for i in range(40)]
    assert compare(spark, v) == 2
    far = whitening.components_of(frame(spark, [(i, [1e12 * i, 0.0]) for i in range(50)])).collect()
    assert any(r.deviation is None for r in far) and all(math.isfinite(r.whitened) for r in far)


def test_solver_restarts_and_takes_few_images():
    a = np.diag([5.0] * 4 + [3.0] * 4 + [0.0] * 92)  # three eigenvalues only: the second block has nothing left after rank 8
    values, vectors, _ = whitening.lanczos(lambda b: a @ b, 100, 8)
    assert np.allclose(values, np.diag(a)[:8]) and np.allclose(vectors.T @ vectors, np.eye(8)) and np.abs(a @ vectors - vectors * values).max() < 1e-12
    d = np.diag(1.0 / (1.0 + np.arange(400.0)) ** 2)
    values, _, steps = whitening.lanczos(lambda b: d @ b, 400, 16)
    assert np.allclose(values, np.diag(d)[:16], rtol=1e-12) and steps < 25
    values, vectors, _ = whitening.lanczos(lambda b: np.zeros_like(b), 6, 16)
    assert np.allclose(values, 0) and np.allclose(vectors.T @ vectors, np.eye(6))
