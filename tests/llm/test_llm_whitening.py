"""Whitening against an eigensolver in doubles, and its exact parts against
plain fractions."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from factlake.llm.whitening import (
    characteristic,
    components,
    exact_products,
    integers,
    isolate,
    polynomial_mod,
    roots_above,
    whiten,
)
from factlake.llm.queries import op13_embedding_whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n string"


def slow_polynomial(a):
    """Faddeev and LeVerrier's recurrence in fractions, highest power first."""
    d = len(a)
    m, out = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        for i in range(d):
            m[i][i] += out[-1]
        m = [[sum(a[i][t] * m[t][j] for t in range(d)) for j in range(d)] for i in range(d)]
        out.append(-sum(m[i][i] for i in range(d)) / k)
    return [int(c) for c in out]


def gram(d, rank, seed, size=50):
    rng = random.Random(seed)
    b = [[rng.randint(-size, size) for _ in range(d)] for _ in range(rank)]
    return np.array([[sum(r[i] * r[j] for r in b) for j in range(d)] for i in range(d)], object)


@pytest.mark.parametrize("d, rank", [(1, 1), (2, 1), (5, 9), (9, 4), (12, 20)])
def test_polynomial_and_its_roots(spark, d, rank):
    matrix = gram(d, rank, d)
    poly = slow_polynomial(matrix.tolist())
    assert characteristic(spark, matrix) == poly
    assert polynomial_mod(matrix, 101) == [c % 101 for c in poly]
    values = np.linalg.eigvalsh(matrix.astype(float))
    for at in [0, 1, 17, int(values[-1] / 2), int(values[-1]) + 2]:
        assert roots_above(poly, at, 0) == (values > at + 1e-6).sum()
    found = isolate(poly, d)
    assert sum(x[3] for x in found) == min(d, rank)


def test_multiple_roots(spark):
    """Three times 4, twice 1/9th of the rest, and zeros: a basis of each space."""
    q = np.array([[1, 1, 1, 1], [1, -1, 1, -1], [1, 1, -1, -1], [1, -1, -1, 1]])
    matrix = (q.T @ np.diag([9, 4, 4, 0]) @ q).astype(object)
    found = components(spark, matrix, 16)
    assert [float(v) for v, _ in found] == pytest.approx([36, 16, 16])
    vectors = np.array([v for _, v in found])
    assert np.allclose(vectors @ vectors.T, np.eye(3), atol=1e-14)
    assert np.allclose(matrix.astype(float) @ vectors.T, vectors.T * [36, 16, 16], atol=1e-12)
    assert len(components(spark, matrix, 2)) == 2 and components(spark, matrix * 0, 2) == []


def test_close_roots(spark):
    """Roots that doubles can hardly tell apart still have their own vectors."""
    matrix = np.array([[10**18, 1, 0], [1, 10**18 + 1, 0], [0, 0, 5]], object)
    found = components(spark, matrix, 3)
    assert float(found[0][0] - found[1][0]) == pytest.approx(math.sqrt(5))
    golden = (1 + math.sqrt(5)) / 2
    v = np.array([1, golden, 0]) / math.hypot(1, golden)
    assert np.allclose(found[0][1], v, atol=1e-15) and np.allclose(np.abs(found[2][1]), [0, 0, 1])


def test_products_are_exact():
    rng = random.Random(5)
    y = np.array([[rng.randint(-(2**50), 2**50) if i % 3 else rng.randint(-9, 9) for _ in range(4)] for i in range(300)])
    own = y.tolist()
    expected = [[sum(r[i] * r[j] for r in own) for j in range(4)] for i in range(4)]
    assert exact_products(y).tolist() == expected


def checked(rows, out):
    """Against numpy's eigenvectors of the distinct rows."""
    usable = {}
    for i, (key, e, *_) in enumerate(rows):
        if e and all(c is not None and math.isfinite(c) for c in e):
            usable[i] = (key, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in e])
    fit = np.array(sorted({tuple(x) for _, x in usable.values()}), object)
    n, sums = len(fit), fit.sum(0)
    centred = (fit - sums / Fraction(n)).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    count = min(16, int((values > values[0] * 1e-12).sum()))
    assert len(out) == len(usable) * count
    found = {}
    for r in out:
        assert r.n == n and r.identity_error < 1e-9 and 1 <= r.component <= count
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        found.setdefault((r.vec_id, r.deviation), {})[r.component] = r.whitened
    signs = {}
    for key, x in usable.values():
        z = n * np.array(x, object) - sums
        own = found[key, int((z * z).sum())]
        w = (z.astype(float) / n) @ vectors[:, :count] / np.sqrt(values[:count])
        for c in range(count):
            sign = signs.setdefault(c, np.sign(own[c + 1] * w[c])) if abs(w[c]) > 1e-3 else None
            assert sign is None or own[c + 1] == pytest.approx(sign * w[c], rel=1e-6, abs=1e-6)


def test_equals_numpy(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    checked(rows, op13_embedding_whitening(spark, sf).collect())


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(3 * d, 1 + d) for d in range(6)], 0, "c", "n") for i in range(80)]
    rows += [(900 + i, rows[3][1], 1, "c", None) for i in range(40)] + [rows[5]] * 3
    rows += [(950, None, 0, "c", "n"), (951, [1.0, None] * 3, 0, "c", "n"), (952, [float("nan")] * 6, 0, "c", "n")]
    rows += [(953, [float("inf")] + [0.0] * 5, 0, "c", "n"), (954, [], 0, "c", "n"), (None, [0.0] * 6, 0, "c", "n")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    checked(rows, whiten(frame).collect())
    longer = frame.unionByName(spark.createDataFrame([(1, [1.0] * 7, 0, "c", "n")], SCHEMA))
    assert whiten(longer).count() == whiten(frame).count()


def test_few_dimensions_one_vector_no_rows(spark):
    rows = [(i, [float(i), 2.0 * i], 0, "c", "n") for i in range(5)]
    frame = spark.createDataFrame(rows, SCHEMA)
    out = whiten(frame).collect()
    assert sorted(r.component for r in out) == [1] * 5 and out[0].explained == pytest.approx(1)
    assert whiten(frame.filter("vec_id = 1")).collect() == []
    assert whiten(frame.limit(0)).collect() == [] and whiten(frame.limit(0)).columns == whiten(frame).columns


def test_huge_entries(spark):
    rows = [(i, [float(10**30) if i == 3 else 1.0, float(i)], 0, "c", "n") for i in range(6)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert max(abs(v - 10**6) for r in integers(frame, "vec_id", "embedding").collect() for v in r._x) == 2**52
    out = whiten(frame).collect()
    assert len(out) == 12 and all(r.deviation is None for r in out) and out[0].identity_error < 1e-6
