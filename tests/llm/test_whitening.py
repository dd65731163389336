from __future__ import annotations

import random
from fractions import Fraction

import numpy as np
import pytest

from odflow.llm.queries import QUERIES
from odflow.llm.whitening import (
    characteristic_polynomial, hessenberg, largest_roots, null_vectors, polynomial_mod, primes_below, roots_above, whiten,
)


def plain_polynomial(matrix):
    """det(x I - matrix) by traces of powers, in fractions."""
    d = len(matrix)
    a = np.array([[Fraction(int(x)) for x in r] for r in matrix], object)
    eye = np.array([[Fraction(int(i == j)) for j in range(d)] for i in range(d)], object)
    out, m = [Fraction(1)], eye * 0
    for k in range(1, d + 1):
        m = a.dot(m) + eye * out[-1]
        out.append(-sum(a.dot(m)[i, i] for i in range(d)) / k)
    return [int(c) for c in out[::-1]]


def symmetric(rng, d, size):
    x = rng.integers(-size, size, (d + 2, d)).astype(object)
    return x.T.dot(x)


def test_primes():
    assert list(primes_below(60)) == [59, 53, 47, 43, 41, 37, 31, 29, 23, 19, 17, 13, 11]
    assert next(primes_below(1 << 31)) == 2**31 - 1


@pytest.mark.parametrize("d", [1, 2, 3, 7, 12])
def test_polynomial(spark, d):
    rng = np.random.default_rng(d)
    m = symmetric(rng, d, 10**9)
    assert characteristic_polynomial(spark, m) == plain_polynomial(m)
    p = 2**31 - 1
    h = hessenberg(np.array([[int(x) % p for x in r] for r in m], np.int64), p)
    assert not np.tril(h, -2).any()
    blocks = np.zeros((6, 6), np.int64)  # with columns that need no step, and row exchanges
    blocks[:3, :3] = [[0, 0, 5], [0, 3, 0], [5, 0, 0]]
    blocks[3:, 3:] = [[2, 1, 0], [1, 2, 0], [0, 0, 7]]
    assert polynomial_mod(blocks % p, p).tolist() == [c % p for c in plain_polynomial(blocks)]


def test_roots_of_known_polynomials():
    roots = [0, 0, 5, 5, 5, 6, 1000, 10**30, 10**30 + 1]
    poly = [1]
    for r in roots:
        poly = [(a - r * b) for a, b in zip([0, *poly], [*poly, 0])]
    assert largest_roots(poly, 99, 10**31) == sorted((r for r in roots if r), reverse=True)
    assert largest_roots(poly, 2, 10**31) == [10**30 + 1, 10**30]
    assert [roots_above(poly, t) for t in (0, 4, 5, 6, 10**30, 10**31)] == [7, 7, 4, 3, 1, 0]
    assert largest_roots([-2 << 2 * 64, 0, 1], 1, 1 << 70) == [26087635650665564425]  # ceil(sqrt(2) * 2^64)


def test_null_vectors_of_a_double_root():
    m = np.array([[2, 0, 0], [0, 2, 0], [0, 0, 5]], object) * 10**20
    v = np.array(null_vectors(m, [2 * 10**20] * 2))
    assert np.allclose(v @ v.T, np.eye(2), atol=1e-15) and np.abs(v[:, 2]).max() < 1e-15


def expected(vectors, most=16):
    """By floating point: whitened rows, spectrum, n, deviations."""
    x = np.floor(64 * np.array(vectors, float)) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), [int(s) for s in fit.sum(0)]
    centred = fit - fit.mean(0)
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    k = min(most, int((e > 1e-9 * e.max()).sum()))
    deviations = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return (x - fit.mean(0)) @ axes[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum(), n, deviations


def agrees(rows, vectors, near=1e-7):
    z, explained, n, deviations = expected(vectors)
    k = z.shape[1]
    assert sorted({r["component"] for r in rows}) == list(range(1, k + 1))
    assert {r["n"] for r in rows} == {n} and max(r["identity_error"] for r in rows) < 1e-10 and len({r["identity_error"] for r in rows}) == 1
    got = np.zeros(z.shape)
    for r in rows:
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviations[r["vec_id"]]
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-7)
    assert np.abs(got - z * np.sign((got * z).sum(0))).max() < near


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS n", "'x' AS component", "2 AS x")


def test_agrees_with_floating_point(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(300, 24)) @ rng.normal(size=(24, 24))).tolist()
    vectors += vectors[:40] + [vectors[0]] * 100  # repeated rows count once in the fit
    out = whiten(frame(spark, list(enumerate(vectors))).repartition(5))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = out.collect()
    assert len(rows) == len(vectors) * 16
    agrees(rows, vectors)


def test_few_dimensions_and_dependent_ones(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-30, 30, (80, 2))
    vectors = np.concatenate([base, base[:, :1] + base[:, 1:], np.zeros((80, 1))], 1).astype(float).tolist()
    agrees(whiten(frame(spark, list(enumerate(vectors)))).collect(), vectors)


def test_equal_eigenvalues(spark):
    """A cross: all directions alike, so any orthonormal basis serves, and the result is white in it."""
    vectors = [[float(s * (i == j)) for j in range(5)] for i in range(5) for s in (1, -1)]
    rows = whiten(frame(spark, list(enumerate(vectors)))).collect()
    z = np.zeros((10, 5))
    for r in rows:
        z[r.vec_id, r.component - 1] = r.whitened
        assert r.explained == pytest.approx(0.2) and r.identity_error < 1e-12
    assert np.allclose(z.T @ z / 10, np.eye(5), atol=1e-12)


def test_odd_rows(spark):
    draw = random.Random(1)
    good = [[draw.gauss(0, 3) for _ in range(3)] for _ in range(50)]
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 0.0, 0.0], [1.0, 2.0], [1.0, 2.0, 3.0, 4.0]]
    rows = [*enumerate(good), *[(100 + i, v) for i, v in enumerate(bad)], (None, good[0])]
    out = whiten(frame(spark, rows)).collect()
    agrees([r for r in out if r.vec_id is not None], good)
    assert {r.vec_id for r in out} == {None, *range(50)} and sum(r.vec_id is None for r in out) == 3
    for few in ([], [(1, good[0])], [(1, good[0]), (2, good[0])], [(1, None)]):
        assert whiten(frame(spark, few)).count() == 0
    huge = whiten(frame(spark, [(0, [1e300, 0.0]), (1, [-1e9, 5.0]), (2, [0.5, -7.0])])).collect()
    assert len(huge) == 6 and all(r.deviation is None for r in huge if r.vec_id == 0) and max(r.identity_error for r in huge) < 1e-6


def test_query_on_given_vectors(spark):
    folder = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    place = {r.vec_id: k for k, r in enumerate(given)}
    rows = [r.asDict() | {"vec_id": place[r.vec_id]} for r in QUERIES["op11_exact_whitening"](spark, folder).collect()]
    agrees(rows, [r.embedding for r in given])
