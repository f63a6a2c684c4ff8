import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.llm import whitening


def brute(vectors, count=4):
    """Whitening by a library's solver: n, deviation and whitened values of each vector, explained shares."""
    x = np.floor(256 * np.asarray(vectors, float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    off = fit - s / n
    cov = off.T @ off / n
    values, found = np.linalg.eigh(cov)
    order = np.argsort(-values)[:count]
    white = (x - s / n) @ found[:, order] / np.sqrt(values[order])
    return n, ((n * x - s) ** 2).sum(1), white, values[order] / np.trace(cov)


def check(got, ids, vectors, count=4):
    n, deviation, white, explained = brute(vectors, count)
    by = {(r.vec_id, r.component): r for r in got}
    assert len(by) == len(got) == len(ids) * count
    for k in range(count):
        rows = [by[i, k + 1] for i in ids]
        mine = np.array([r.whitened for r in rows])
        sign = np.sign(mine @ white[:, k])
        assert np.allclose(mine, sign * white[:, k], rtol=1e-8, atol=1e-9)
        assert [r.deviation for r in rows] == deviation.tolist()
        assert all(r.n == n and abs(r.explained / explained[k] - 1) < 1e-10 for r in rows)
        assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9


def test_the_table(spark, folder):
    given = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = given.collect()
    check(whitening.whitened_rows(given.repartition(5)).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_repeated_vectors_odd_rows_and_clashing_names(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(60, 7)).round(3).tolist()
    vectors += [vectors[0]] * 40 + [[-0.0] * 7]
    nan, inf = float("nan"), float("inf")
    odd = [(900, None), (901, []), (902, [nan] * 7), (903, [inf] * 7), (904, [1.0, None] * 3 + [0.0]), (905, [1e300] * 7)]
    given = spark.createDataFrame([*enumerate(vectors), *odd], "vec_id long, embedding array<double>")
    given = given.withColumn("x", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("component", F.lit(2)).withColumn("place", F.lit(3))
    got = whitening.whitened_rows(given.repartition(9)).collect()
    check(got, range(len(vectors)), vectors)


def test_lengths_repeated_rows_and_null_ids(spark):
    rng = np.random.default_rng(6)
    long, short = rng.normal(size=(30, 6)).tolist(), rng.normal(size=(9, 2)).tolist()
    rows = [*enumerate(long), *enumerate(short, 100), (None, long[0]), (3, long[3])]
    got = whitening.whitened_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sum(r.vec_id is None for r in got) == 4 and sum(r.vec_id == 3 for r in got) == 8
    check([r for r in got if r.vec_id is not None and r.vec_id >= 100], range(100, 109), short, 2)
    assert {r.n for r in got if r.vec_id == 5} == {30}


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_without_variance_there_are_no_rows(spark, rows):
    assert whitening.whitened_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == 0


def test_deviation_beyond_a_long(spark):
    vectors = [[float(i * 10**9), float(i * i * 10**8)] for i in range(50)]
    given = spark.createDataFrame([*enumerate(vectors)], "vec_id long, embedding array<double>")
    got = whitening.whiten(given).collect()
    x = [[int(256 * c) for c in v] for v in vectors]
    s = [sum(c) for c in zip(*x)]
    assert {r.vec_id: int(r.deviation) for r in got} == {i: sum((50 * c - t) ** 2 for c, t in zip(v, s)) for i, v in enumerate(x)}
    assert all(r.deviation is None for r in whitening.whitened_rows(given).collect() if r.vec_id == 49)


def spread(values, seed=1):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize(
    "matrix",
    [
        spread(np.arange(40.0)),
        spread([5, 5, 5, 5, 1, 1, 0, 0]),  # one value several times
        spread([1, 1 - 1e-13, 1 - 2e-13, 0.5, 0.1]),  # values that nearly agree
        spread(np.geomspace(1e-12, 1, 20)),
        np.diag([3.0, 1, 2, 2, 0]),  # already diagonal
        np.kron(np.eye(3), spread([4.0, 2, 1])),  # falls apart into equal blocks
        1e-200 * spread(np.arange(6.0)),
        1e200 * spread(np.arange(6.0)),
        np.array([[2.0]]),
        np.array([[2.0, 1], [1, 2]]),
    ],
)
def test_leading_against_a_library(matrix):
    matrix = (matrix + matrix.T) / 2
    values, found = whitening.leading(matrix, 5)
    size = np.abs(matrix).max()
    want = np.linalg.eigvalsh(matrix / size)[::-1][: len(values)] * size
    assert len(values) == min(5, len(matrix)) and np.allclose(values / size, want / size, atol=1e-13)
    assert np.allclose(found @ found.T, np.eye(len(values)), atol=1e-12)
    assert np.allclose(found @ (matrix / size), found * (values / size)[:, None], atol=1e-12)


def test_sign_changes_count_smaller_eigenvalues():
    matrix = spread([3.0, 1, 4, 1, 5, 9, 2, 6])
    diagonal, off, _ = whitening.tridiagonal(matrix)
    points = np.array([0.0, 1.5, 2.5, 5.5, 10])
    assert whitening.below(diagonal, off, points).tolist() == [0, 2, 3, 6, 8]
