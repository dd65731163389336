"""Embedding whitening from the exact characteristic polynomial of the integer scatter matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
#: Scaled components are held to this magnitude, so that sums of products stay within 38 digits.
LARGEST = float(1 << 44)
#: Roots are found to this many bits below the trace, and null spaces with as many more.
ROOT_BITS = 128
GUARD_BITS = 256
#: Eigenvalues nearer than this many bits below the trace share a null space for the sake of orthogonality.
NEAR_BITS = 60
EXACT, LONG = float(1 << 53), 1 << 63


def whole_points(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): floor(64 c) + 1000000 of each entry; vectors that are null or empty or hold a null or non-finite entry are out."""
    c = F.transform("embedding", lambda e: e.cast("double"))
    sound = vectors.select("vec_id", c.alias("c")).where(
        (F.coalesce(F.size("c"), F.lit(0)) > 0) & F.forall("c", lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)))
    )
    held = F.transform("c", lambda e: F.floor(F.least(F.greatest(e * SCALE, F.lit(-LARGEST)), F.lit(LARGEST))) + SHIFT)
    return sound.select("vec_id", held.alias("x"))


def points_of(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch less the shift, as rows."""
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) - SHIFT


def products(rows: np.ndarray) -> np.ndarray:
    """Exact sums of products of all columns, as whole Python numbers."""
    most = float(np.abs(rows).max(initial=0))
    if most * most * len(rows) < EXACT:
        exact = rows.astype(np.float64)
        return np.rint(exact.T @ exact).astype(np.int64).astype(object)
    return rows.astype(object).T @ rows.astype(object)


def scatter(points: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """n, S and n * sum(y y') - S S' over ``points``, whole numbers all; y is x less the shift.

    Each task adds up its own products; only a row per pair of dimensions leaves it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, square = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for batch in batches:
            if batch.num_rows:
                rows = points_of(batch)
                n, sums, square = n + len(rows), sums + rows.sum(0).astype(object), square + products(rows)
        if n:
            i, j = np.triu_indices(dim)
            values = [Decimal(n), *map(Decimal, sums), *map(Decimal, square[i, j])]
            first = np.concatenate([[-1], np.full(dim, -1), i])
            second = np.concatenate([[-1], np.arange(dim), j])
            yield pa.RecordBatch.from_arrays(
                [pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array(values, pa.decimal128(38, 0))], names=["i", "j", "v"]
            )

    parts = points.mapInArrow(run, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    n, sums, square = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
    for i, j, v in parts:
        if j < 0:
            n = int(v)
        elif i < 0:
            sums[j] = int(v)
        else:
            square[i, j] = square[j, i] = int(v)
    return n, sums.tolist(), n * square - np.outer(sums, sums)


def primes_below(limit: int) -> Iterator[int]:
    """Primes under ``limit`` (at most 2^31), falling."""
    bases = (2, 3, 5, 7)  # enough for numbers of 31 bits
    for p in range(limit - 1 - limit % 2, 10, -2):
        odd, twos = p - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in bases:
            x = pow(base, odd, p)
            if x not in (1, p - 1) and all((x := x * x % p) != p - 1 for _ in range(twos - 1)):
                break
        else:
            yield p


def hessenberg(matrix: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to ``matrix`` modulo the prime p, with zeros below the first subdiagonal."""
    h, d = matrix.copy(), len(matrix)
    for m in range(1, d - 1):
        found = np.flatnonzero(h[m:, m - 1])
        if not len(found):
            continue
        k = m + int(found[0])
        if k != m:
            h[[m, k]] = h[[k, m]]
            h[:, [m, k]] = h[:, [k, m]]
        factors = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factors[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factors % p).sum(1)) % p
    return h


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x I - matrix) modulo p, constant first."""
    h, d = hessenberg(matrix, p), len(matrix)
    found = np.zeros((d + 1, d + 1), np.int64)  # of the leading submatrices
    found[0, 0] = 1
    below = np.zeros(0, np.int64)  # products of the subdiagonal from each row to the present one
    for k in range(d):
        if k:
            below = np.append(below, 1) * h[k, k - 1] % p
        row = np.roll(found[k], 1) - h[k, k] * found[k] % p
        if k:
            row = row - ((h[:k, k] * below % p)[:, None] * found[:k] % p).sum(0)
        found[k + 1] = row % p
    return found[d]


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Coefficients of det(x I - matrix), constant first, for a positive semidefinite matrix of whole numbers.

    The coefficients are elementary symmetric functions of the eigenvalues, the largest of which the trace
    bounds; enough primes for that bound are taken, each reduced in a Spark task of its own, and the residues are
    put together by Chinese remaindering.
    """
    d, trace = len(matrix), int(np.trace(matrix))
    bound = 2 * max(math.comb(d, k) * (trace**k // d**k + 1) for k in range(d + 1)) + 1
    primes, product = [], 1
    for p in primes_below(1 << 31):
        primes.append(p)
        product *= p
        if product > bound:
            break
    rows = [[int(a) for a in r] for r in matrix]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                p = primes[k]
                residues = np.array([[a % p for a in r] for r in rows], np.int64)
                found = polynomial_mod(residues, p).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([found], pa.list_(pa.int64()))], names=["p", "residues"])

    tasks = min(len(primes), max(1, spark.sparkContext.defaultParallelism))
    found = spark.range(0, len(primes), 1, tasks).mapInArrow(run, "p long, residues array<long>").collect()
    out = [0] * (d + 1)
    for p, residues in found:
        rest = product // p
        unit = rest * pow(rest % p, -1, p)
        out = [c + unit * r for c, r in zip(out, residues, strict=True)]
    return [c - product if c > product // 2 else c for c in (c % product for c in out)]


def roots_above(poly: list[int], t: int) -> int:
    """How many roots exceed t, with multiplicity, if all are real: the sign changes of the polynomial shifted to t."""
    shifted = poly[:]
    for k in range(len(shifted) - 1):
        for i in range(len(shifted) - 2, k - 1, -1):
            shifted[i] += t * shifted[i + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def sign_at(poly: list[int], t: int) -> int:
    value = 0
    for c in reversed(poly):
        value = value * t + c
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], most: int, above: int) -> list[int]:
    """The ``most`` largest positive roots of a polynomial with real roots, falling, rounded up to whole numbers.

    ``above`` exceeds every root. Intervals are halved until one root or one whole number is left in each; a
    single root is then closed in on by the sign alone. Equal roots come as often as they occur.
    """
    zeros = next(k for k, c in enumerate(poly) if c)
    poly = poly[zeros:]  # the roots at 0
    out: list[int] = []
    waiting = [(0, above, len(poly) - 1, 0)]  # open below, closed above, roots inside and above; the highest last
    while waiting and len(out) < most:
        low, high, count, over = waiting.pop()
        if not count:
            continue
        if high - low == 1:
            out += [high] * count
        elif count == 1:
            end = sign_at(poly, high)
            while end and high - low > 1:
                middle = (low + high) // 2
                sign = sign_at(poly, middle)
                if sign in (0, end):
                    high, end = middle, sign
                else:
                    low = middle
            out.append(high)
        else:
            middle = (low + high) // 2
            upper = roots_above(poly, middle) - over
            waiting += [(low, middle, count - upper, over + upper), (middle, high, upper, over)]
    return out[:most]


def unit(vector: np.ndarray, bits: int) -> np.ndarray:
    return np.array([(int(v) << bits) for v in vector], object) // max(math.isqrt(sum(int(v) * int(v) for v in vector)), 1)


def null_vectors(matrix: np.ndarray, roots: list[int], bits: int = GUARD_BITS) -> list[np.ndarray]:
    """Unit eigenvectors of ``matrix`` for (nearly) equal whole ``roots``, by inverse iteration in fixed point.

    Each root's matrix is factored with row exchanges; two solves from a fixed start vector, each made orthogonal
    to the vectors before, are enough as roots are known far beyond the gaps that doubles can tell apart.
    """
    d, one = len(matrix), 1 << bits
    out: list[np.ndarray] = []  # with ``bits`` binary places
    factored: dict[int, tuple] = {}
    for k, root in enumerate(roots):
        if root not in factored:
            factored.clear()
            u = np.array([[int(a) << bits for a in r] for r in matrix], object)
            u[np.arange(d), np.arange(d)] -= root << bits
            swaps, factors = [], []
            for c in range(d):
                best = max(range(c, d), key=lambda r: abs(u[r, c]))
                swaps.append(best)
                if best != c:
                    u[[c, best]] = u[[best, c]]
                u[c, c] = u[c, c] or 1
                f = (u[c + 1 :, c] << bits) // u[c, c]
                factors.append(f)
                u[c + 1 :, c:] -= (f[:, None] * u[c, c:]) >> bits
            factored[root] = u, swaps, factors
        u, swaps, factors = factored[root]
        v = np.array([one + ((i * 7919 + k * 104729 + i * i * 31) % 1009 << bits - 10) for i in range(d)], object)
        for _ in range(2):
            b = v.copy()
            for c in range(d):
                if swaps[c] != c:
                    b[c], b[swaps[c]] = b[swaps[c]], b[c]
                b[c + 1 :] -= (factors[c] * b[c]) >> bits
            for c in range(d - 1, -1, -1):
                b[c] = (b[c] << bits) // u[c, c]
                b[:c] -= (u[:c, c] * b[c]) >> bits
            v = unit(b, bits)
            for _ in range(2):
                for w in out:
                    v = v - (w * (int((v * w).sum()) >> bits) >> bits)
                v = unit(v, bits)
        out.append(v)
    return [np.array([int(x) / one for x in v]) for v in out]


def components(spark: SparkSession, matrix: np.ndarray, most: int) -> tuple[list[Fraction], np.ndarray]:
    """The ``most`` largest eigenvalues above 0 and their unit eigenvectors as columns, of a scatter matrix.

    The largest entry of each vector in magnitude (the first of equals) is positive. Vectors of each group of near
    eigenvalues are found in a Spark task of their own.
    """
    d, trace = len(matrix), int(np.trace(matrix))
    if trace == 0:
        return [], np.zeros((d, 0))
    spread = max(0, ROOT_BITS - trace.bit_length())
    poly = characteristic_polynomial(spark, matrix)
    scaled = [c << spread * (d - k) for k, c in enumerate(poly)]
    roots = largest_roots(scaled, most, (trace << spread) + 1)
    near = max(1, (trace << spread) >> NEAR_BITS)
    groups: list[list[int]] = []
    for root in roots:
        if groups and groups[-1][-1] - root <= near:
            groups[-1].append(root)
        else:
            groups.append([root])
    fine = matrix * (1 << spread)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in batch.column("id").to_pylist():
                for place, v in enumerate(null_vectors(fine, groups[g])):
                    rows = [pa.array([g]), pa.array([place]), pa.array([v.tolist()], pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays(rows, names=["g", "place", "v"])

    found = spark.range(0, len(groups), 1, len(groups)).mapInArrow(run, "g long, place long, v array<double>").collect()
    vectors = np.array([r["v"] for r in sorted(found, key=lambda r: (r["g"], r["place"]))]).T
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return [Fraction(r, 1 << spread) for r in roots], vectors * signs


def identity_error(matrix: np.ndarray, n: int, weights: np.ndarray) -> float:
    """Largest entry of the covariance of the projections on ``weights``, less the identity: exact until the end."""
    bits = 200
    w = np.array([[int(Fraction(float(x)) * (1 << bits)) for x in r] for r in weights], object)
    covariance = w.T.dot(matrix).dot(w)
    whole = n * n << 2 * bits
    identity = whole * np.eye(len(covariance), dtype=int).astype(object)
    return float(Fraction(int(abs(covariance - identity).max()), whole))


RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, most: int = 16) -> DataFrame:
    """A row for each vector and component up to ``most``: vec_id, component, n, deviation, whitened, explained, identity_error.

    ``vectors`` has vec_id and embedding. Each entry c becomes x = floor(64 c) + 1000000. The fit is over the distinct x
    vectors: their number n, their sums S and the covariance V with divisor n, all from exact whole numbers. Components
    are V's unit eigenvectors by falling eigenvalue e, from the characteristic polynomial of n * n * V. ``whitened`` is
    (x - S / n) on the component over sqrt(e); ``deviation`` the sum of (n x - S)^2, null where it exceeds a long;
    ``explained`` is e over V's trace; ``identity_error`` says how far the covariance of ``whitened`` is from the identity.

    Null and empty vectors and those with a null or non-finite entry are dropped. The length that most vectors have (of
    equals the shortest) is the space; vectors of another length are left out. Magnitudes of 64 c beyond 2^44 are held to
    it. Repeated rows count once in the fit and each has its own rows in the result, as have null ids. Components with
    e = 0 cannot be scaled and have no rows; so an empty table, one vector or equal vectors give no rows. Equal
    eigenvalues have any orthonormal basis of their space, the same for all rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    sound = whole_points(vectors)
    lengths = sound.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = lengths["d"] if lengths else 0
    points = sound.where(F.size("x") == dim)
    n, sums, matrix = scatter(points.select("x").distinct(), dim) if dim else (0, [], np.zeros((0, 0), object))
    roots, axes = components(spark, matrix, most) if n else ([], np.zeros((0, 0)))
    if not roots:
        return spark.createDataFrame([], f"vec_id {id_type}, {RESULT}")
    trace = int(np.trace(matrix))
    values = [float(r / (n * n)) for r in roots]
    explained = np.array([float(r / trace) for r in roots])
    weights = axes / np.sqrt(values)
    error = identity_error(matrix, n, weights)
    k = len(roots)
    largest = max(map(abs, sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = points_of(batch)
            small = (n * int(np.abs(y).max()) + largest) ** 2 * dim < LONG
            moved = n * y - np.array(sums, np.int64) if small else n * y.astype(object) - np.array(sums, object)
            squares = (moved * moved).sum(1)
            squares = pa.array(squares if small else [s if s < LONG else None for s in squares.tolist()], pa.int64())
            z = (moved.astype(np.float64) / n) @ weights
            rows = len(y)
            each = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n)), squares.take(each), pa.array(z.reshape(-1)), pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return points.mapInArrow(run, f"vec_id {id_type}, {RESULT}")
