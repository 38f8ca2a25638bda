import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerframe.llm import whitening as op
from ledgerframe.llm.queries import QUERIES


def brute(vectors):
    """x of each kept vector, the distinct ones, exact sums, and eigenvalues and vectors of their covariance by the library."""
    x = {i: [math.floor(64 * float(c)) + 1_000_000 for c in v] for i, v in vectors.items() if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = sorted({tuple(v) for v in x.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    mean = [Fraction(s, n) for s in sums]
    centred = np.array([[float(c - m) for c, m in zip(v, mean, strict=True)] for v in fit])
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    return x, n, sums, values[::-1], directions[:, ::-1], centred


def check(rows, vectors, components=16, tol=1e-6):
    x, n, sums, values, directions, centred = brute(vectors)
    real = [k for k in range(min(components, len(values))) if values[k] > 1e-12 * values[0]]
    by_id = {}
    for r in rows:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    assert set(by_id) == set(x)
    for k in real:
        found = np.array([by_id[i][k + 1].whitened for i in x])
        exact = np.array([[float(c - Fraction(s, n)) for c, s in zip(v, sums, strict=True)] for v in x.values()]) @ directions[:, k] / math.sqrt(values[k])
        assert np.abs(found - exact).max() < tol or np.abs(found + exact).max() < tol
        explained = {by_id[i][k + 1].explained for i in x}
        assert len(explained) == 1 and explained.pop() == pytest.approx(values[k] / values.sum(), rel=1e-9)
    for i, v in x.items():
        assert set(by_id[i]) == {k + 1 for k in real}
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))
        assert {(r.n, r.deviation) for r in by_id[i].values()} == {(n, deviation)}
        assert all(r.identity_error < 1e-9 for r in by_id[i].values())


def test_query_equals_the_library_on_the_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    vectors = {r.vec_id: r.embedding for r in table.collect()}
    out = QUERIES["op12_whitening"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    check(out.collect(), vectors)


def test_nulls_copies_and_other_columns(spark):
    rng = np.random.default_rng(1)
    vectors = {i: [float(c) for c in rng.normal(size=5) * [9, 3, 1, 0.3, 0.1]] for i in range(300)}
    vectors |= {i: vectors[3] for i in range(300, 500)}
    vectors |= {500: None, 501: [1.0, None, 1.0, 1.0, 1.0], 502: [float("nan"), 1.0, 1.0, 1.0, 1.0], 503: [1.0, 1.0, float("-inf"), 1.0, 1.0], 504: [], 505: [1.0, 2.0]}
    good = {i: v for i, v in vectors.items() if i < 500}
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors.items()], "vec_id long, embedding array<double>, rid string, `n` int").repartition(5)
    check(op.by_component(op.whiten(table)).collect(), good)
    # Ids may be null or repeated.
    more = table.select(F.when(F.col("vec_id") % 2 == 0, F.col("vec_id")).alias("vec_id"), "embedding")
    rows = op.whiten(more).collect()
    assert len(rows) == 500 and sum(r.vec_id is None for r in rows) == 250 and {r.n for r in rows} == {300}


def test_empty_and_constant_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert op.whiten(spark.createDataFrame([], schema)).count() == 0
    assert op.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    same = op.whiten(spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], schema))
    assert [(r.vec_id, r.n, r.deviation, r.whitened) for r in same.orderBy("vec_id").collect()] == [(1, 1, 0, []), (2, 1, 0, [])]
    assert op.by_component(same).count() == 0
    # Two vectors vary in one direction.
    two = op.by_component(op.whiten(spark.createDataFrame([(1, [0.0, 0.0, 1.0]), (2, [1.0, 2.0, 1.0])], schema))).collect()
    assert {(r.vec_id, r.component, abs(round(r.whitened, 9))) for r in two} == {(1, 1, 1.0), (2, 1, 1.0)}


@pytest.mark.parametrize("size", [1, 2, 7, 40])
def test_jacobi_equals_the_library(size):
    rng = np.random.default_rng(size)
    m = rng.normal(size=(size, size + 3))
    m = m @ m.T
    values, vectors = op.jacobi(m)
    assert np.allclose(values, np.linalg.eigvalsh(m)[::-1], rtol=1e-12)
    assert np.allclose(m @ vectors, vectors * values, atol=1e-10) and np.allclose(vectors.T @ vectors, np.eye(size), atol=1e-13)


def test_jacobi_keeps_small_eigenvalues_accurate():
    # Scaled by powers of two, so that the eigenvalues span 24 orders; the smallest of a graded matrix is known from its determinant.
    scale = np.array([1.0, 2.0**-20, 2.0**-40])
    core = np.array([[4, 1, 1], [1, 3, 1], [1, 1, 2]], float)
    values, _ = op.jacobi(core * scale[:, None] * scale)
    assert np.prod(values) == pytest.approx(np.linalg.det(core) * np.prod(scale) ** 2, rel=1e-12)
    assert values[2] == pytest.approx(scale[2] ** 2 * np.linalg.det(core) / np.linalg.det(core[:2, :2]), rel=1e-9)
    assert op.jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def test_sums_and_deviations_are_exact_beyond_doubles(spark):
    rows = [(1, [2.0**44, 1.0]), (2, [2.0**44 + 1, 2.0]), (3, [2.0**44 + 2, 5.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    check(op.by_component(op.whiten(table)).collect(), dict(rows))
