"""Whitening against plain exact sums, another way to the polynomial, and numpy's eigenvectors."""

from fractions import Fraction

import numpy as np
import pytest

from tablesmith.llm import whitening
from tablesmith.llm.queries import QUERIES
from tablesmith.llm.whitening import Moments, characteristic, components, greatest_roots, moments, null_vectors, whiten

SF_DIR = "/root/testdata/sf0.001"


def by_traces(matrix):
    """Coefficients of the characteristic polynomial from powers of the matrix, constant first."""
    d = len(matrix)
    own = [[Fraction(int(x)) for x in row] for row in matrix]
    out, power = [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        for i in range(d):
            power[i][i] += out[-1]
        power = [[sum(own[i][m] * power[m][j] for m in range(d)) for j in range(d)] for i in range(d)]
        out.append(-sum(power[i][i] for i in range(d)) / k)
    return [int(c) for c in reversed(out)]


def scatter(rows):
    x = np.array(rows, object)
    return len(x) * x.T.dot(x) - np.outer(x.sum(axis=0), x.sum(axis=0))


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0.0) for i, v in rows], "vec_id bigint, embedding array<float>, component int, whitened double")


@pytest.mark.parametrize("size, count, most", [(1, 3, 5), (2, 2, 9), (5, 40, 100), (9, 60, 10**6), (7, 4, 30)])
def test_polynomial(spark, size, count, most):
    rows = np.random.default_rng(size).integers(-most, most, (count, size))
    assert characteristic(spark, scatter(rows)) == by_traces(scatter(rows))


def test_roots():
    product = lambda roots: np.array([1], object) if not roots else np.convolve(product(roots[1:]), np.array([-roots[0], 1], object))
    for roots in ([3], [5, 5, 5], [1, 2, 3, 4], [10**12, 10**12 + 1, 7, 7, 0, 0], [0, 0], [8, 4, 2, 1, 1, 1]):
        found = greatest_roots(product(roots).tolist(), 32, 50)
        expected = sorted({(r, roots.count(r)) for r in roots if r}, reverse=True)
        assert [(round(r / 2**50), m) for r, m in found] == expected
        assert all(abs(Fraction(f, 2**50) - r) <= Fraction(1, 2**50) for (f, _), (r, _) in zip(found, expected))
    # An irrational root: x * x - 6 x + 7, greater root 3 + sqrt(2).
    root = greatest_roots([7, -6, 1], 1, 200)[0][0]
    assert (root - 3 * 2**200) ** 2 <= 2 * 2**400 < (root + 1 - 3 * 2**200) ** 2


def test_null_space_of_close_roots():
    """Eigenvalues that doubles cannot tell apart still give their own vectors."""
    values = [10**18 + 1, 10**18, 5]
    turn = [[Fraction(3, 5), Fraction(-4, 5), 0], [Fraction(4, 5), Fraction(3, 5), 0], [0, 0, Fraction(1)]]
    matrix = np.array([[sum(turn[i][k] * values[k] * turn[j][k] for k in range(3)) * 25 for j in range(3)] for i in range(3)], object)
    matrix = np.vectorize(int, otypes=[object])(matrix)
    for k, value in enumerate(values):
        (vector,) = null_vectors(matrix, 25 * value << 200, 200, 1)
        assert abs(abs(sum(float(turn[i][k]) * vector[i] for i in range(3))) - 1) < 1e-15


def test_query(spark):
    got = QUERIES["op13_embedding_whitening"](spark, SF_DIR).toPandas().sort_values(["vec_id", "component"])
    source = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.floor(np.array(source["embedding"].tolist(), np.float64) * 64) + 1_000_000
    n = len(x)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    w = got["whitened"].to_numpy().reshape(n, 32)
    assert got["component"].tolist() == list(range(1, 33)) * n and set(got["n"]) == {n}
    expected = (x - x.mean(axis=0)) @ vectors / np.sqrt(values)
    signs = np.sign((w * expected).sum(axis=0))
    assert np.abs(w - expected * signs).max() < 1e-8
    assert np.abs(w.T @ w / n - np.eye(32)).max() < 1e-12 and got["identity_error"].max() < 1e-12
    assert np.allclose(got["explained"].to_numpy().reshape(n, 32), values / np.trace(np.cov(x.T, bias=True)), rtol=1e-10, atol=0)
    integers = x.astype(np.int64).astype(object)
    assert got["deviation"].tolist()[::32] == [int(((n * row - integers.sum(axis=0)) ** 2).sum()) for row in integers]


def test_odd_rows(spark):
    rows = [
        (1, [0.5, 0.25]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("-inf"), 1.0]), (None, [-0.5, 2.0]),
        (7, [0.5, 0.25]), (7, [0.125, 3.0]), (8, []), (9, [1.0]), (10, [1.0, 2.0, 3.0]),
    ]
    got = whiten(table(spark, rows)).orderBy("vec_id", "deviation", "component").collect()
    x = [[32, 16], [-32, 128], [32, 16], [8, 192]]
    deviation = lambda row: sum((4 * v - sum(c)) ** 2 for v, c in zip(row, zip(*x)))
    assert [(r["vec_id"], r["component"]) for r in got] == [(i, c) for i in (None, 1, 7, 7) for c in (1, 2)]
    assert sorted(r["deviation"] for r in got[::2]) == sorted(map(deviation, x))
    assert {r["n"] for r in got} == {4} and abs(sum({r["explained"] for r in got}) - 1) < 1e-12
    assert got[0]["identity_error"] < 1e-12


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 1.0])], [(1, [0.5]), (2, [0.5])], [(1, [])]])
def test_nothing_to_whiten(spark, rows):
    out = whiten(table(spark, rows))
    assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_repeated_eigenvalues(spark):
    """Unit vectors and their opposites: all eigenvalues are equal; and a column that follows another."""
    rows = [(2 * i + s, [(1.0 - 2 * s) * (i == j) for j in range(40)]) for i in range(40) for s in (0, 1)]
    got = whiten(table(spark, rows)).toPandas().sort_values(["vec_id", "component"])
    w = got["whitened"].to_numpy().reshape(80, 32)
    assert np.abs(w.T @ w / 80 - np.eye(32)).max() < 1e-12 and np.allclose(got["explained"], 1 / 40)
    dependent = [(i, [float(a), 2.0 * a, float(b)]) for i, (a, b) in enumerate([(1, 0), (2, 5), (3, 1), (0, 0)])]
    assert {r["component"] for r in whiten(table(spark, dependent)).collect()} == {1, 2}


def test_large_entries(spark):
    """Sums beyond what doubles and longs hold stay exact."""
    rows = [(1, [1e9, 1.0]), (2, [-3e9, 2.0]), (3, [2.5e9, 7.0])]
    own = moments(table(spark, rows))
    x = [[int(np.floor(np.float64(np.float32(v)) * 64)) for v in r] for _, r in rows]
    assert own.sums == [sum(c) for c in zip(*x)] and (own.scatter == scatter(x)).all()
    whole = Moments(3, own.sums, own.scatter)
    assert len(components(spark, whole).eigenvalues) == 2
    with pytest.raises(Exception, match="too large|fit|overflow|convert"):
        whiten(table(spark, [(1, [1e30]), (2, [2e30])])).collect()


def test_products_in_parts(monkeypatch):
    y = np.random.default_rng(3).integers(-(2**19), 2**19, (40_000, 3))
    big = y.astype(object)
    assert (whitening._products(y) == big.T.dot(big)).all()
