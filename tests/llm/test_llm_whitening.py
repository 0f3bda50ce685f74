"""Embedding whitening against numpy's eigenvectors and Python's integers."""

import math

import numpy as np
import pytest

from vicinity.llm import whitening
from vicinity.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, component string, n int, vec string, dim int"


def _table(spark, rows):
    return spark.createDataFrame([(i, v, "c", 1, "v", 2) for i, v in rows], SCHEMA)


def _whitened(vectors, **options):
    return whitening.whiten(vectors, whitening.fit(vectors, **options)).collect()


def _brute(rows):
    """Usable rows, exact sums over distinct grid vectors, and the covariance with 30 digits more than doubles have."""
    usable = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v in rows
              if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in usable})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    d = len(sums)
    centred = [[n * x[j] - sums[j] for j in range(d)] for x in fit]
    cov = np.array([[sum(r[i] * r[j] for r in centred) / n ** 3 for j in range(d)] for i in range(d)])
    return usable, n, sums, cov


def _check(rows, got, components=16):
    usable, n, sums, cov = _brute(rows)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = int((values > 1e-9 * values[0]).sum())
    k = min(components, rank)
    assert len(got) == len(usable) * k
    by_row = {}
    for r in got:
        by_row.setdefault((r["vec_id"] is None, r["vec_id"], r["deviation"]), []).append(r)
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(cov), rel=1e-9)
    signs = {}
    for i, x in usable:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        found = by_row[i is None, i, deviation]
        z = np.array([(n * a - s) / n for a, s in zip(x, sums)])
        for r in found:
            c = r["component"] - 1
            want = float(z @ vectors[:, c] / math.sqrt(values[c]))
            if abs(want) > 1e-3:
                signs.setdefault(c, set()).add(math.copysign(1, want * r["whitened"]))
            assert abs(abs(want) - abs(r["whitened"])) < 1e-6
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 5)) * [5, 3, 2, 1, 0.5] + [0, 100, -7, 0, 3]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(i, rows[3][1]) for i in range(1000, 1200)]  # a hot vector weighs as one
    rows += [(3, rows[3][1]), (None, rows[4][1]), (2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0]), (2002, []),
             (2003, [float("nan"), 0.0, 0.0, 0.0, 0.0]), (2004, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    got = _whitened(_table(spark, rows).repartition(7))
    usable = [r for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in got if r["component"] == 1) == sorted(
        (i is None, i or 0) for i, _ in usable)
    _check(rows, got)


def test_components_stop_at_the_rank(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(-200, 200, size=(100, 3))
    rows = [(i, [float(x), float(y), float(x + y), float(z), 4.0]) for i, (x, y, z) in enumerate(a)]
    got = _whitened(_table(spark, rows))
    assert max(r["component"] for r in got) == 3
    _check(rows, got)
    assert max(r["component"] for r in _whitened(_table(spark, rows), components=2)) == 2


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])]])
def test_no_variance_no_rows(spark, rows):
    vectors = _table(spark, rows)
    assert _whitened(vectors) == []
    assert whitening.whiten(vectors, whitening.fit(vectors)).dtypes == [
        ("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"),
        ("explained", "double"), ("identity_error", "double")]


def test_commonest_length_counts(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=3 if i % 3 else 2) * 10]) for i in range(30)]
    got = _whitened(_table(spark, rows))
    assert {r["vec_id"] for r in got} == {i for i in range(30) if i % 3}


def test_large_entries(spark):
    rows = [(i, [float(i) * 2 ** 40, float(i * i % 17) * 2 ** 20]) for i in range(20)] + [(99, [1e300, 0.0]), (98, [3e38, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = _whitened(vectors)
    assert {r["vec_id"] for r in got} == set(range(20))
    assert all(r["deviation"] is None for r in got if r["vec_id"] in (0, 19))  # beyond a long
    assert max(r["identity_error"] for r in got) < 1e-9


@pytest.mark.parametrize("n,rank", [(1, 1), (2, 2), (7, 7), (40, 40), (12, 5)])
def test_cholesky_and_jacobi(n, rank):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, rank)) * np.logspace(0, -4, rank)
    a = a @ a.T
    factor, pivots = whitening.pivoted_cholesky(a)
    assert factor.shape == (n, rank) and np.allclose(factor @ factor.T, a, atol=1e-15)
    assert np.allclose(np.triu(factor[pivots], 1), 0)
    values, vectors = whitening.one_sided_jacobi(factor)
    assert np.allclose(vectors.T @ vectors, np.eye(rank), atol=1e-12) and (np.diff(values) <= 0).all()
    assert np.allclose(vectors * values @ vectors.T, a, atol=1e-14)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:rank], rtol=1e-6, atol=1e-14)  # eigvalsh is right to ulps of the largest


def test_small_eigenvalues_keep_their_digits():
    scale = np.array([1.0, 1e-5, 1e-10])
    base = np.array([[1, 0.3, 0.2], [0.3, 1, 0.1], [0.2, 0.1, 1]])
    values, _ = whitening.one_sided_jacobi(whitening.pivoted_cholesky(base * np.outer(scale, scale))[0])
    assert np.prod(values) == pytest.approx(np.linalg.det(base) * np.prod(scale) ** 2, rel=1e-12)


def test_query_on_the_small_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    _check(rows, QUERIES["op11_embedding_whitening"](spark, "/root/testdata/sf0.001").collect())
