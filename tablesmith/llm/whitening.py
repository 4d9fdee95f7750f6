"""Whitening of embeddings by eigenvectors whose eigenvalues are roots of an exact polynomial."""

from collections.abc import Iterator
from dataclasses import dataclass

from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tablesmith.session import materialize, release

# Entries as integers: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
# Eigenvalues are known to this part of the trace (as a power of two), solves use more places.
ROOT_BITS, SOLVE_BITS = 300, 420

WHITENED = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


# ---- integers of the vectors ------------------------------------------------------------------


def _clean(embeddings: DataFrame, vector: str, *keep: str) -> DataFrame:
    """The vectors as ``v`` (doubles): not null and without a null or non-finite entry."""
    own = embeddings.select(F.col(vector).cast("array<double>").alias("v"), *keep)
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return own.where(F.col("v").isNotNull() & finite)


def _integers(column: pa.ListArray, size: int) -> np.ndarray:
    """``floor(SCALE * c)`` of vectors of ``size`` entries; what is shifted by SHIFT must be a long."""
    scaled = np.floor(column.flatten().to_numpy(zero_copy_only=False) * SCALE)
    if len(scaled) and np.abs(scaled).max() >= 2.0**62:
        raise ValueError("an entry is too large to be counted as a long")
    return scaled.astype(np.int64).reshape(-1, size)


def _products(y: np.ndarray) -> np.ndarray:
    """The exact sum of outer products as Python integers: in doubles where all sums are below 2**53."""
    most = int(np.abs(y).max()) if y.size else 0
    if len(y) * most * most < 2**53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    if most < 2**20:
        return sum(_products(part) for part in np.array_split(y, 1 + len(y) * most * most // 2**52))
    return y.astype(object).T @ y.astype(object)


@dataclass
class Moments:
    """``n`` vectors of integers, their sums, and the scatter ``n * sum(y y') - s s'``: n squared covariances."""

    n: int
    sums: list[int]
    scatter: np.ndarray


def moments(embeddings: DataFrame, vector: str = "embedding") -> Moments | None:
    """Exact moments of the clean vectors of the most frequent length (of equals, the greatest).

    Each task adds up its own rows; Spark adds the cells of all tasks, so the driver gets one
    number per pair of dimensions.
    """

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            sizes = np.array(batch["size"].to_pylist(), np.int64)
            for size in np.unique(sizes).tolist():
                y = _integers(batch["v"].filter(pa.array(sizes == size)), size)
                own = held.setdefault(size, [0, np.zeros(size, object), np.zeros((size, size), object)])
                own[0] += len(y)
                own[1] = own[1] + (y.sum(axis=0) if np.abs(y).max() < 2**40 else y.astype(object).sum(axis=0))
                own[2] = own[2] + _products(y)
        for size, (n, s, g) in held.items():
            upper = np.triu_indices(size)
            values = [n, *s.tolist(), *g[upper].tolist()]
            columns = [pa.array([size] * len(values), pa.int32()), pa.array(range(len(values)), pa.int64())]
            text = pa.array([str(v) for v in values])
            yield pa.RecordBatch.from_arrays([*columns, text], names=["size", "cell", "total"])

    rows = _clean(embeddings, vector).withColumn("size", F.size("v")).where("size > 0")
    cells = rows.mapInArrow(add_up, "size int, cell bigint, total string")
    paths: list[str] = []
    cells = cells.groupBy("size", "cell").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    cells = materialize(cells, "moments", paths)
    counts = cells.where("cell = 0").orderBy(F.desc("total"), F.desc("size")).limit(1).collect()
    size, n = (counts[0]["size"], int(counts[0]["total"])) if counts else (0, 0)
    totals = {r["cell"]: int(r["total"]) for r in cells.where(F.col("size") == size).collect()}
    release(embeddings.sparkSession, paths)
    if not counts:
        return None
    s = [totals[1 + i] for i in range(size)]
    scatter = np.zeros((size, size), object)
    for at, (i, j) in enumerate(zip(*np.triu_indices(size))):
        scatter[i, j] = scatter[j, i] = n * totals[1 + size + at] - s[i] * s[j]
    return Moments(n, s, scatter)


# ---- the characteristic polynomial ------------------------------------------------------------


def _is_prime(p: int) -> bool:
    """Miller and Rabin's test with bases that settle all numbers below 3.4e14."""
    if p < 2 or any(p % q == 0 for q in (2, 3, 5, 7, 11, 13, 17)):
        return p in (2, 3, 5, 7, 11, 13, 17)
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7, 11, 13, 17):
        x = pow(base, odd, p)
        if x not in (1, p - 1) and all((x := x * x % p) != p - 1 for _ in range(twos - 1)):
            return False
    return True


def primes() -> Iterator[int]:
    """Primes below 2**31, greatest first; products of two residues stay below 2**62."""
    return filter(_is_prime, range(2**31 - 1, 2**30, -2))


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to ``a`` modulo ``p`` with zeros below its first subdiagonal."""
    a = a.copy()
    for m in range(1, len(a) - 1):
        below = np.flatnonzero(a[m:, m - 1])
        if not len(below):
            continue
        if below[0]:
            swap = [m, m + below[0]]
            a[swap] = a[swap[::-1]]
            a[:, swap] = a[:, swap[::-1]]
        u = a[m + 1 :, m - 1] * pow(int(a[m, m - 1]), -1, p) % p
        a[m + 1 :] = (a[m + 1 :] - u[:, None] * a[m] % p) % p
        a[:, m] = (a[:, m] + (a[:, m + 1 :] * u % p).sum(axis=1)) % p
    return a


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of ``det(x - matrix)`` modulo ``p``, constant first."""
    h, d = hessenberg((matrix % p).astype(np.int64), p), len(matrix)
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(1, d + 1):
        factors, below = np.zeros(k, np.int64), 1
        for i in range(k, 0, -1):
            factors[i - 1] = int(h[i - 1, k - 1]) * below % p
            below = below * int(h[i - 1, i - 2]) % p if i > 1 else 0
        minors[k, 1:] = minors[k - 1, :-1]
        minors[k] = (minors[k] - (factors[:, None] * minors[:k] % p).sum(axis=0)) % p
    return minors[d]


def _bound(matrix: np.ndarray) -> int:
    """No elementary symmetric function of the eigenvalues (none is negative) is greater."""
    d, trace = len(matrix), int(np.trace(matrix))
    return max(comb(d, k) * (-(-trace // d)) ** k for k in range(d + 1))


def combine(residues: list[tuple[int, list[int]]]) -> list[int]:
    """Numbers from 0 to the product of the primes with these residues."""
    whole = 1
    for p, _ in residues:
        whole *= p
    out = [0] * len(residues[0][1])
    for p, own in residues:
        rest = whole // p
        factor = rest * pow(rest, -1, p)
        out = [o + factor * r for o, r in zip(out, own)]
    return [o % whole for o in out]


def characteristic(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """``det(x - matrix)`` of a positive semidefinite integer matrix, constant first, exactly.

    One row per prime is spread over the cluster; as many primes are taken as the greatest
    possible coefficient needs.
    """
    bound, chosen, whole = 2 * _bound(matrix), [], 1
    for p in primes():
        if whole > bound:
            break
        chosen.append(p)
        whole *= p
    held, d = spark.sparkContext.broadcast(matrix), len(matrix)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch["p"].to_pylist()
            found = pa.array([polynomial_mod(held.value, q).tolist() for q in p], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["p"], found], names=["p", "c"])

    tasks = min(len(chosen), spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(p,) for p in chosen], "p bigint").repartition(tasks).mapInArrow(reduce, "p bigint, c array<bigint>")
    # Signs alternate from the leading coefficient; with them all values are at least 0.
    signs = [(-1) ** (d - k) for k in range(d + 1)]
    residues = [(r["p"], [s * c % r["p"] for s, c in zip(signs, r["c"])]) for r in rows.collect()]
    return [s * c for s, c in zip(signs, combine(residues))]


# ---- its roots --------------------------------------------------------------------------------


class _Roots:
    """The polynomial in ``2**places * x``, whose roots are all real and positive."""

    def __init__(self, coefficients: list[int]):
        self.coefficients = coefficients

    def value(self, z: int, places: int) -> int:
        """Its value at ``z / 2**places`` times a positive factor that depends on ``places`` alone."""
        out = 0
        for k, c in enumerate(reversed(self.coefficients)):
            out = out * z + (c << places * k)
        return out

    def above(self, z: int, places: int) -> int:
        """How many roots are greater than ``z / 2**places``: the changes of sign after a shift by it.

        By Descartes' rule, which is exact for polynomials with real roots only.
        """
        d = len(self.coefficients) - 1
        c = np.array([c << places * (d - k) for k, c in enumerate(self.coefficients)], object)
        for k in range(d):
            for j in range(d - 1, k - 1, -1):
                c[j] += z * c[j + 1]
        signs = [x > 0 for x in c.tolist() if x]
        return sum(a != b for a, b in zip(signs, signs[1:]))


def _refine(roots: _Roots, low: int, places: int, final: int) -> int:
    """The place at ``final`` places of the one root in ``(low, low + 1] / 2**places``, by quadratic refinement."""
    bits = 2
    at_low, at_high = roots.value(low, places), roots.value(low + 1, places)
    if at_high == 0:
        return (low + 1) << (final - places)
    while places < final:
        bits = min(bits, final - places)
        parts, d = 1 << bits, len(roots.coefficients) - 1
        lift = bits * d
        low, places = low << bits, places + bits
        # Where a straight line through both ends would cross zero, and its neighbours.
        guess = min(max(at_low * parts // (at_low - at_high), 0), parts - 1)
        cuts = {0: at_low << lift, parts: at_high << lift}
        for cut in (guess, guess + 1):
            if cut not in cuts:
                cuts[cut] = roots.value(low + cut, places)
            if cuts[cut] == 0:
                return (low + cut) << (final - places)
        if (cuts[guess] > 0) == (cuts[guess + 1] > 0):
            bits = max(1, bits // 2)
            # The line was wrong: find the part by halving.
            a, b = (guess + 1, parts) if (cuts[guess] > 0) == (at_low > 0) else (0, guess)
            while b - a > 1:
                middle = (a + b) // 2
                cuts[middle] = roots.value(low + middle, places)
                if cuts[middle] == 0:
                    return (low + middle) << (final - places)
                a, b = (middle, b) if (cuts[middle] > 0) == (at_low > 0) else (a, middle)
            guess = a
        else:
            bits *= 2
        low, at_low, at_high = low + guess, cuts[guess], cuts[guess + 1]
    return low


def greatest_roots(coefficients: list[int], most: int, places: int) -> list[tuple[int, int]]:
    """The ``most`` greatest positive roots times ``2**places``, falling, with how often each occurs.

    Roots nearer to each other than ``2**-places`` count as one that occurs several times.
    """
    zero = next(k for k, c in enumerate(coefficients) if c)
    own = coefficients[zero:]
    roots, degree = _Roots(own), len(own) - 1
    # The greatest root is at most the sum of all.
    top = max(1, -own[-2] // own[-1]).bit_length() if degree else 0
    found, open_ = [], [(0, -top, degree, 0)] if degree else []
    # Intervals (low, low + 1] / 2**places with the number of roots in and above them, greatest on top.
    while open_ and sum(m for _, m in found) < most:
        low, at, count, over = open_.pop()
        if count == 1 and at >= 0:
            found.append((_refine(roots, low, at, places) if at < places else low, 1))
        elif at >= places:
            found.append((low, count))
        else:
            middle = 2 * low + 1
            higher = roots.above(middle, at + 1) if at + 1 >= 0 else roots.above(middle << -(at + 1), 0)
            higher -= over
            open_ += [(low_, at + 1, n, o) for low_, n, o in ((2 * low, count - higher, over + higher), (middle, higher, over)) if n]
    return found


# ---- components -------------------------------------------------------------------------------


def null_vectors(matrix: np.ndarray, root: int, places: int, count: int) -> list[list[float]]:
    """``count`` orthonormal vectors of the null space of ``matrix - root / 2**places`` by inverse iteration.

    In integers with SOLVE_BITS places, relative to the trace: the root is off by less than any
    gap to the next, so two solves leave nothing but the null space.
    """
    d, trace, one = len(matrix), int(np.trace(matrix)), 1 << SOLVE_BITS
    a = np.array([[(int(x) << SOLVE_BITS) // trace for x in row] for row in matrix], object)
    a[np.diag_indices(d)] -= ((root << SOLVE_BITS) >> places) // trace
    order = np.arange(d)
    for k in range(d):
        pivot = k + int(np.argmax([abs(x) for x in a[k:, k]]))
        a[[k, pivot]], order[[k, pivot]] = a[[pivot, k]], order[[pivot, k]]
        a[k, k] = a[k, k] or 1
        for i in range(k + 1, d):
            a[i, k] = (a[i, k] << SOLVE_BITS) // a[k, k]
        a[k + 1 :, k + 1 :] -= (a[k + 1 :, k, None] * a[k, k + 1 :]) >> SOLVE_BITS

    def solve(b: np.ndarray) -> np.ndarray:
        z = b[order].copy()
        for k in range(1, d):
            z[k] -= (a[k, :k] @ z[:k]) >> SOLVE_BITS
        for k in range(d - 1, -1, -1):
            z[k] = ((z[k] - ((a[k, k + 1 :] @ z[k + 1 :]) >> SOLVE_BITS if k + 1 < d else 0)) << SOLVE_BITS) // a[k, k]
        return z

    def unit(z: np.ndarray) -> np.ndarray:
        length = isqrt(int(z @ z))
        return np.array([(int(x) << SOLVE_BITS) // length for x in z], object)

    out, dice = [], np.random.default_rng(13)
    for _ in range(count):
        z = np.array([int(x) * (one >> 20) for x in dice.integers(2**18, 2**20, d) * dice.choice([-1, 1], d)], object)
        for _ in range(3):
            z = unit(solve(z))
            for other in out:
                z = z - ((other * int(z @ other)) >> 2 * SOLVE_BITS)
            z = unit(z)
        out.append(z)
    return [[int(x) / one for x in z] for z in out]


@dataclass
class Components:
    """Unit vectors by falling eigenvalue of the covariance, with the parts of the trace they explain."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    explained: np.ndarray
    vectors: np.ndarray


def components(spark: SparkSession, own: Moments, most: int = COMPONENTS) -> Components:
    """The components of positive eigenvalue, at most ``most``; one task solves for one of them."""
    trace, d = int(np.trace(own.scatter)), len(own.sums)
    if not trace:
        return Components(own.n, own.sums, np.zeros(0), np.zeros(0), np.zeros((0, d)))
    places = max(1, ROOT_BITS - trace.bit_length())
    found = greatest_roots(characteristic(spark, own.scatter), most, places)
    held = spark.sparkContext.broadcast(own.scatter)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, root, count in zip(*(batch[n].to_pylist() for n in ("at", "root", "count"))):
                vectors = null_vectors(held.value, int(root), places, count)
                columns = [pa.array([at] * count, pa.int32()), pa.array(range(count), pa.int32()), pa.array(vectors, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["at", "part", "vector"])

    rows = spark.createDataFrame([(i, str(r), m) for i, (r, m) in enumerate(found)], "at int, root string, count int")
    solved = rows.repartition(len(found), "at").mapInArrow(solve, "at int, part int, vector array<double>").collect()
    solved = sorted(solved, key=lambda r: (r["at"], r["part"]))[:most]
    values = [found[r["at"]][0] for r in solved]
    scale = 1 << places
    return Components(
        own.n, own.sums, np.array([v / (scale * own.n**2) for v in values]), np.array([v / (scale * trace) for v in values]),
        np.array([r["vector"] for r in solved]),
    )


# ---- whitened vectors -------------------------------------------------------------------------


def _centred(y: np.ndarray, own: Components) -> tuple[np.ndarray, list[int]]:
    """``x - S / n`` of each row, and the exact squared length of ``n * x - S``."""
    most = max(map(abs, own.sums)) + own.n * (int(np.abs(y).max()) if y.size else 0)
    kind = np.int64 if most * most * len(own.sums) < 2**63 else object
    away = own.n * y.astype(kind) - np.array(own.sums, kind)
    return away.astype(np.float64) / own.n, (away * away).sum(axis=1).tolist()


def _project(away: np.ndarray, own: Components) -> np.ndarray:
    return (away @ own.vectors.T) / np.sqrt(own.eigenvalues)


def identity_error(rows: DataFrame, own: Components) -> float:
    """The greatest difference between the whitened rows' covariance and the identity."""
    k, size = len(own.eigenvalues), len(own.sums)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = _project(_centred(_integers(batch["v"], size), own)[0], own)
            sums, products = sums + w.sum(axis=0), products + w.T @ w
        values = np.concatenate([sums, products[np.triu_indices(k)]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["cell", "total"])

    cells = rows.select("v").mapInArrow(add_up, "cell bigint, total double").groupBy("cell").agg(F.sum("total").alias("total"))
    totals = np.array([r["total"] for r in cells.orderBy("cell").collect()]) / own.n
    i, j = np.triu_indices(k)
    return float(np.abs(totals[k:] - totals[i] * totals[j] - (i == j)).max())


def whiten(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id", most: int = COMPONENTS) -> DataFrame:
    """``key`` and the columns of WHITENED, a row per vector and component.

    Entries count as ``floor(64 c) + 1000000``. Components are the eigenvectors of the
    covariance of all remaining vectors, by falling eigenvalue; ``whitened`` is the centred
    vector's part along one, over the root of the eigenvalue. The scatter is summed as
    integers, its characteristic polynomial found modulo many primes and combined, its
    greatest roots separated by exact counts and refined to ROOT_BITS bits, and each component
    solved for in integers of SOLVE_BITS places.

    Vectors that are null or hold a null, infinite or undefined entry are left out, and so are
    vectors of another length than most have. Components of eigenvalue 0 cannot be whitened
    and have no rows; so a table of equal vectors, of one vector or of none gives no rows.
    Eigenvectors of a repeated eigenvalue are some orthonormal basis, the same for all rows.
    Repeated rows and null keys are rows like all others; other columns are ignored. An entry
    or a deviation that does not fit a long is an error.
    """
    spark, names = embeddings.sparkSession, embeddings.select(key).schema[0].dataType.simpleString()
    schema_text = f"`{key}` {names}, {WHITENED}"
    own = moments(embeddings, vector)
    found = components(spark, own, most) if own else None
    if not found or not len(found.eigenvalues):
        return spark.createDataFrame([], schema_text)
    size, k, schema = len(found.sums), len(found.eigenvalues), to_arrow_schema(StructType.fromDDL(schema_text))
    rows = _clean(embeddings, vector, key).where(F.size("v") == size)
    error = identity_error(rows, found)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1_024):
                batch = whole.slice(at, 1_024)
                away, deviation = _centred(_integers(batch["v"], size), found)
                times = np.repeat(np.arange(batch.num_rows), k)
                columns = [
                    batch[key].take(pa.array(times)), np.tile(np.arange(1, k + 1), batch.num_rows), np.full(len(times), found.n),
                    np.repeat(np.array(deviation, np.int64), k), _project(away, found).ravel(),
                    np.tile(found.explained, batch.num_rows), np.full(len(times), error),
                ]
                columns = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return rows.mapInArrow(apply, schema_text)
