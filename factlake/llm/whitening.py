"""Whitening of embeddings by exact principal components.

Entries become integers (floor of `SCALE` times the entry, plus `OFFSET`). Over
the distinct vectors Spark adds up, exactly, counts, sums, and the products of
entries that are centred on whole numbers first. From these follows the scatter
n * sum(x x') - S S', an integer matrix of d x d numbers; what is done with it
no longer depends on the number of rows:

1. Its characteristic polynomial modulo many primes, each by Hessenberg
   reduction in a task; Chinese remaindering gives the integer coefficients.
   They alternate in sign and add up to at most (1 + trace / d) ** d, which says
   how many primes are enough.
2. The polynomial has real roots only, so the sign changes of its coefficients
   shifted by a are the number of roots above a: bisection isolates the
   largest roots with their multiplicity, in whole numbers and, where roots
   are close, binary fractions.
3. In a task per root, bisection on signs refines it to `ROOT_BITS` bits, and
   inverse iteration in fixed-point numbers gives the null space of matrix
   minus root. A vector's largest entry is made positive.

Roots that agree in `ROOT_BITS` bits count as one multiple root, whose
components are some orthonormal basis of its null space.

Rows with a null vector, or a null or non-finite entry, are left out, as are
empty vectors and those of another length than most rows have (ties: the
longer). Entries beyond 2**52 / `SCALE` are taken as that. Repeated vectors
count once in every sum, but every row gets its own result; null ids are kept.
Only directions with a positive variance are components: one distinct vector
has none, and then, as with an empty table, there are no rows. `deviation` is
null where it does not fit a long. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from decimal import Decimal
from fractions import Fraction
from math import gcd, isqrt, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm.texts import fields
from factlake.operators.scale import materialize

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
ROWS = 4_096
LIMB = 20
ROOT_BITS = 120
FIXED_BITS = 320
SUMS = "i int, j int, total decimal(38,0)"


def integers(df: DataFrame, key: str, column: str) -> DataFrame:
    """key and x (`_x`) of the rows that can be used."""
    most = 2.0**52 / SCALE
    usable = df.filter(
        f"size(`{column}`) > 0 AND forall(`{column}`, c -> c IS NOT NULL"
        " AND NOT isnan(c) AND abs(CAST(c AS DOUBLE)) < double('infinity'))"
    )
    clipped = f"least(greatest(CAST(c AS DOUBLE), {-most}D), {most}D)"
    found = usable.selectExpr(
        f"`{key}`", f"transform(`{column}`, c -> CAST(floor({SCALE} * {clipped}) AS BIGINT) + {OFFSET}L) AS _x"
    )
    lengths = found.groupBy(F.size("_x").alias("length")).count().orderBy(F.desc("count"), F.desc("length"))
    length = lengths.first()
    return found.filter(F.size("_x") == (length[0] if length else 0))


def _blocks(batches: Iterable[pa.RecordBatch], column: str = "_x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            part = batch.slice(first, ROWS)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _sums(total: dict[tuple[int, int], int]) -> Iterator[pa.RecordBatch]:
    at = list(total)
    if at:
        values = pa.array([Decimal(total[k]) for k in at], pa.decimal128(38, 0))
        parts = [pa.array([k[0] for k in at], pa.int32()), pa.array([k[1] for k in at], pa.int32()), values]
        yield pa.RecordBatch.from_arrays(parts, names=["i", "j", "total"])


def _collected(rows: DataFrame) -> dict[tuple[int, int], int]:
    """Sums over all tasks; a row per pair of dimensions."""
    found = rows.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    return {(r.i, r.j): int(r.total) for r in found}


def column_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """n and S."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for part, x in _blocks(batches):
            high, low = (x >> 31).sum(0), (x & ((1 << 31) - 1)).sum(0)
            total[0, -1] = total.get((0, -1), 0) + part.num_rows
            for i, (h, w) in enumerate(zip(high.tolist(), low.tolist())):
                total[0, i] = total.get((0, i), 0) + (h << 31) + w
        yield from _sums(total)

    found = _collected(fit.mapInArrow(run, SUMS))
    return found.pop((0, -1), 0), [found[0, i] for i in range(len(found))]


def exact_products(y: np.ndarray) -> np.ndarray:
    """y' y as Python integers. Numbers are cut into limbs of 20 bits, so all
    sums of products of `ROWS` rows are below 2**53."""
    limbs = []
    while True:
        if np.abs(y).max(initial=0) < 1 << LIMB:
            limbs.append(y.astype(float))
            break
        limbs.append((y & ((1 << LIMB) - 1)).astype(float))
        y = y >> LIMB
    out = np.zeros((y.shape[1], y.shape[1]), object)
    for a, left in enumerate(limbs):
        for b, right in enumerate(limbs):
            out += (left.T @ right).astype(np.int64).astype(object) << (LIMB * (a + b))
    return out


def scatter(fit: DataFrame, n: int, sums: Sequence[int]) -> np.ndarray:
    """n * sum(x x') - S S', of entries centred on the whole number nearest to
    their mean before they are multiplied."""
    means = [(2 * s + n) // (2 * n) for s in sums]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, out = np.array(means, np.int64), None
        for _, x in _blocks(batches):
            found = exact_products(x - centre)
            out = found if out is None else out + found
        d = len(means)
        yield from _sums({} if out is None else {(i, j): out[i, j] for i in range(d) for j in range(i, d)})

    found = _collected(fit.mapInArrow(run, SUMS))
    rest = [s - n * m for s, m in zip(sums, means)]
    d = len(means)
    out = np.zeros((d, d), object)
    for (i, j), total in found.items():
        out[i, j] = out[j, i] = n * total - rest[i] * rest[j]
    return out


def primes_below(top: int, count: int) -> list[int]:
    """The largest `count` primes below `top` (at most 2**31)."""
    small = [q for q in range(2, isqrt(top) + 1) if all(q % r for r in range(2, isqrt(q) + 1))]
    factors, out = np.array(small), []
    while len(out) < count:
        top -= 1
        if np.all(top % factors):
            out.append(top)
    return out


def polynomial_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Characteristic polynomial modulo p, highest power first: elimination to
    Hessenberg form, then the recurrence along its diagonal."""
    a = (matrix % p).astype(np.int64)
    d = len(a)
    for k in range(d - 2):
        below = np.flatnonzero(a[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            a[[k + 1, pivot]] = a[[pivot, k + 1]]
            a[:, [k + 1, pivot]] = a[:, [pivot, k + 1]]
        factors = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - factors[:, None] * a[k + 1] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * factors % p).sum(1)) % p
    # of the leading k x k parts, lowest power first
    found = np.zeros((d + 1, d + 1), np.int64)
    found[0, 0] = 1
    for k in range(1, d + 1):
        found[k, 1:] = found[k - 1, :-1]
        weights, below = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):
            weights[i] = int(a[i, k - 1]) * below % p
            below = below * int(a[i, i - 1]) % p if i else 0
        found[k] = (found[k] - (weights[:, None] * found[:k] % p).sum(0)) % p
    return found[d, ::-1].tolist()


def characteristic(spark, matrix: np.ndarray) -> list[int]:
    """The polynomial's integers, highest power first."""
    d, trace = len(matrix), int(np.trace(matrix))
    bits = int(d * log2(1 + Fraction(trace, d))) + 8
    primes = primes_below(1 << 31, -(-bits // 30))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            rests = pa.array([polynomial_mod(matrix, p) for p in own], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), rests], names=["p", "rests"])

    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 64), "p")
    modulus, out = 1, [0] * (d + 1)
    for p, rests in rows.mapInArrow(run, "p bigint, rests array<bigint>").collect():
        inverse = pow(modulus, -1, p)
        out = [c + modulus * ((r - c) * inverse % p) for c, r in zip(out, rests)]
        modulus *= p
    return [c - modulus if k % 2 and c else c for k, c in enumerate(out)]


def roots_above(poly: Sequence[int], at: int, bits: int) -> int:
    """How many roots are above at / 2**bits: sign changes of the coefficients
    of the polynomial shifted there."""
    shifted = [c << (bits * k) for k, c in enumerate(poly)]
    for last in range(len(shifted) - 1, 0, -1):
        for k in range(1, last + 1):
            shifted[k] += at * shifted[k - 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def isolate(poly: Sequence[int], count: int) -> list[tuple[int, int, int, int]]:
    """The largest roots, at least `count` of them where there are as many
    above 0: (low, bits, roots above high, multiplicity) of the interval
    (low, low + 1] / 2**bits, from the largest on."""
    top = max(1, (-poly[1]).bit_length()) if len(poly) > 1 else 1
    rank = max(k for k, c in enumerate(poly) if c)
    finest = ROOT_BITS - top
    out: list[tuple[int, int, int, int]] = []
    # low / 2**bits, roots above high, roots inside
    todo = [(0, -top, 0, rank)]
    while todo and sum(x[3] for x in out) < count:
        low, bits, above, inside = todo.pop()
        if inside == 1 and bits >= 0 or bits >= max(finest, 1):
            out.append((low, bits, above, inside))
            continue
        bits, low = bits + 1, 2 * low
        split = roots_above(poly, (low + 1) << -bits, 0) if bits < 0 else roots_above(poly, low + 1, bits)
        # the upper half is looked at first
        if above + inside - split:
            todo.append((low, bits, split, above + inside - split))
        if split - above:
            todo.append((low + 1, bits, above, split - above))
    return out


def refine(poly: Sequence[int], low: int, bits: int, above: int) -> tuple[int, int]:
    """A simple root of (low, low + 1] / 2**bits, as number / 2**bits with
    `ROOT_BITS` more bits: the sign right of it is that of (-1)**above."""
    for _ in range(ROOT_BITS):
        low, bits = 2 * low, bits + 1
        value = 0
        for k, c in enumerate(poly):
            value = value * (low + 1) + (c << (bits * k))
        if value == 0:
            return low + 1, bits
        low += (value > 0) == (above % 2 == 1)
    return 2 * low + 1, bits + 1


def null_space(matrix: np.ndarray, root: int, bits: int, size: int) -> np.ndarray:
    """`size` orthonormal vectors (rows) that matrix minus root / 2**bits turns
    to next to nothing: inverse iteration, in fixed-point numbers."""
    d = len(matrix)
    own = (matrix << FIXED_BITS).astype(object)
    shift = root << (FIXED_BITS - bits) if bits <= FIXED_BITS else root >> (bits - FIXED_BITS)
    own[np.arange(d), np.arange(d)] -= shift
    order, lower = list(range(d)), np.zeros((d, d), object)
    for k in range(d):
        pivot = k + int(np.argmax(np.abs(own[k:, k])))
        own[[k, pivot]], lower[[k, pivot]] = own[[pivot, k]], lower[[pivot, k]]
        order[k], order[pivot] = order[pivot], order[k]
        own[k, k] = own[k, k] or 1
        lower[k + 1 :, k] = (own[k + 1 :, k] << FIXED_BITS) // own[k, k]
        own[k + 1 :, k:] -= (lower[k + 1 :, k, None] * own[k, k:]) >> FIXED_BITS

    def solved(b: np.ndarray) -> np.ndarray:
        x = b[order].copy()
        for k in range(d):
            x[k + 1 :] -= (lower[k + 1 :, k] * x[k]) >> FIXED_BITS
        for k in range(d - 1, -1, -1):
            x[k] = (x[k] << FIXED_BITS) // own[k, k]
            x[:k] -= (own[:k, k] * x[k]) >> FIXED_BITS
        return x

    def unit(x: np.ndarray) -> np.ndarray:
        return (x << FIXED_BITS) // (isqrt(int((x * x).sum())) or 1)

    start = np.random.default_rng(0).integers(1, 1 << 30, (size, d))
    base = [unit(row.astype(object) << FIXED_BITS) for row in start]
    for _ in range(3):
        found: list[np.ndarray] = []
        for x in base:
            x = unit(solved(x))
            for _ in range(2):
                for y in found:
                    x = x - ((y * (int((x * y).sum()) >> FIXED_BITS)) >> FIXED_BITS)
            found.append(unit(x))
        base = found
    out = np.array([[float(Fraction(int(c), 1 << FIXED_BITS)) for c in x] for x in base])
    largest = out[np.arange(size), np.abs(out).argmax(1)]
    return out * np.sign(largest)[:, None]


def components(spark, matrix: np.ndarray, count: int) -> list[tuple[Fraction, list[float]]]:
    """The largest positive eigenvalues of an integer matrix, each with its
    unit vector."""
    content = gcd(*[int(c) for c in matrix.ravel()])
    if not content:
        return []
    matrix = matrix // content
    poly = characteristic(spark, matrix)
    found = [(number, str(low), bits, above, size) for number, (low, bits, above, size) in enumerate(isolate(poly, count))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                root, bits = int(r["low"]) * 2 + 1, r["bits"] + 1
                if r["size"] == 1:
                    root, bits = refine(poly, int(r["low"]), r["bits"], r["above"])
                vectors = null_space(matrix, root, bits, r["size"]).tolist()
                yield pa.RecordBatch.from_pylist(
                    [{"number": r["number"], "root": str(root), "bits": bits, "vectors": vectors}],
                    pa.schema({"number": pa.int32(), "root": pa.string(), "bits": pa.int32(), "vectors": pa.list_(pa.list_(pa.float64()))}),
                )

    kind = "number int, low string, bits int, above int, size int"
    rows = spark.createDataFrame(found, kind).repartition(min(len(found), 64), "number")
    solved = rows.mapInArrow(run, "number int, root string, bits int, vectors array<array<double>>").collect()
    out = []
    for r in sorted(solved, key=lambda r: r.number):
        out += [(Fraction(int(r.root) * content, 1 << r.bits), list(v)) for v in r.vectors]
    return out[:count]


def whiten(df: DataFrame, key: str = "vec_id", column: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: key, component, n, deviation,
    whitened, explained, identity_error."""
    rows = integers(df, key, column)
    out = f"{fields(df, [key])}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    fit = materialize(rows.select("_x").distinct(), "fit")
    n, sums = column_sums(fit)
    matrix = scatter(fit, n, sums) if n else np.zeros((1, 1), object)
    found = components(df.sparkSession, matrix, count)
    if not found:
        return df.sparkSession.createDataFrame([], out)
    values = [float(value / n**2) for value, _ in found]
    explained = [float(value / int(np.trace(matrix))) for value, _ in found]
    scaled = np.array([v for _, v in found]).T / np.sqrt(values)
    means = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, means)]

    def whitened(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = x - np.array(means, np.int64)
        return y, (y - np.array(rest, float) / n) @ scaled

    error = _identity_error(fit, whitened, n, len(found))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches):
            y, w = whitened(x)
            rough = ((n * y.astype(float) - np.array(rest, float)) ** 2).sum(1)
            fits = rough < 9e18
            deviation = ((n * np.where(fits[:, None], y, 0) - np.array(rest, np.int64) * fits[:, None]) ** 2).sum(1)
            size, many = len(found), part.num_rows
            at = np.repeat(np.arange(many), size)
            columns = [
                part.column(key).take(pa.array(at)),
                pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), many)),
                pa.array(np.full(many * size, n)),
                pa.array(deviation[at], mask=~fits[at]),
                pa.array(w.ravel()),
                pa.array(np.tile(explained, many)),
                pa.array(np.full(many * size, error)),
            ]
            names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, out)


def _identity_error(fit: DataFrame, whitened, n: int, size: int) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((size, size)), np.zeros(size)
        for _, x in _blocks(batches):
            w = whitened(x)[1]
            products, sums = products + w.T @ w, sums + w.sum(0)
        i, j = (np.append(a, np.full(size, b)) for a, b in zip(np.triu_indices(size), (0, -1)))
        i[-size:] = np.arange(size)
        values = np.append(products[np.triu_indices(size)], sums)
        parts = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(values)]
        yield pa.RecordBatch.from_arrays(parts, names=["i", "j", "total"])

    sums = fit.mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))
    found = {(r.i, r.j): r.total / n for r in sums.collect()}
    return max(
        abs(v - found[i, -1] * found[j, -1] - (i == j)) for (i, j), v in found.items() if j >= 0
    )
