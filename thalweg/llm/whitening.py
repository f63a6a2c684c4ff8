"""Whitening of embeddings: leading components of their covariance, scaled to unit variance.

Spark sums what grows with the rows: distinct vectors, sums per dimension, and
products of centred entries.  What is left is one square matrix, as wide as a
vector; its leading eigenvectors are found on the driver by reduction to three
diagonals, counts of sign changes and inverse iteration.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

COMPONENTS = 4
#: An entry c counts as floor(SCALE * c).
SCALE = 256
#: Rows that a task multiplies at once.
BLOCK = 4096
#: Eigenvalues nearer to each other than this share of the largest are one cluster.
CLUSTER = 1e-3
_EPS = float(np.finfo(float).eps)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal, off-diagonal and mirrors of a symmetric matrix: each mirror clears a column below its neighbour."""
    a = np.array(matrix, float)
    mirrors: list[np.ndarray | None] = []
    for k in range(len(a) - 2):
        column = a[k + 1 :, k].copy()
        if not np.any(column[1:]):
            mirrors.append(None)
            continue
        column /= (scale := np.abs(column).max())
        length = -math.copysign(float(np.linalg.norm(column)), column[0])
        column[0] -= length
        u = column / np.linalg.norm(column)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ u
        w = p - (u @ p) * u
        rest -= 2 * (np.outer(u, w) + np.outer(w, u))
        a[k + 1, k] = length * scale
        mirrors.append(u)
    return a.diagonal().copy(), a.diagonal(-1).copy(), mirrors


def below(diagonal: np.ndarray, off: np.ndarray, points: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each point: the negative terms of its Sturm sequence."""
    least = np.finfo(float).tiny * max(1.0, float((off * off).max(initial=0)))
    q = np.full(len(points), np.inf)
    count = np.zeros(len(points), int)
    for i, d in enumerate(diagonal):
        q = d - points - (off[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def largest(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, falling, each halved down to neighbouring numbers."""
    reach = np.abs(np.r_[off, 0.0]) + np.abs(np.r_[0.0, off])
    spread = float((np.abs(diagonal) + reach).max(initial=0)) * (1 + 4 * _EPS) + np.finfo(float).tiny
    low, high = np.full(count, -spread), np.full(count, spread)
    place = len(diagonal) - 1 - np.arange(count)  # so many eigenvalues are smaller
    while True:
        middle = low + (high - low) / 2
        if not ((middle > low) & (middle < high) & (high - low > np.finfo(float).tiny)).any():
            return middle
        above = below(diagonal, off, middle) > place
        high, low = np.where(above, middle, high), np.where(above, low, middle)


def _solver(diagonal: np.ndarray, off: np.ndarray, value: float, least: float):
    """Elimination with row exchanges of (three diagonals - value); returns a function that solves for a right side."""
    n = len(diagonal)
    main, upper, second = (diagonal - value).tolist(), [*off.tolist(), 0.0], [0.0] * n
    lower = off.tolist()
    steps = []
    for i in range(n - 1):
        swap = abs(lower[i]) > abs(main[i])
        if swap:
            main[i], lower[i] = lower[i], main[i]
            upper[i], main[i + 1] = main[i + 1], upper[i]
            if i + 2 < n:
                second[i], upper[i + 1] = upper[i + 1], 0.0
        main[i] = main[i] if abs(main[i]) > least else least
        factor = lower[i] / main[i]
        main[i + 1] -= factor * upper[i]
        if swap and i + 2 < n:
            upper[i + 1] -= factor * second[i]
        steps.append((swap, factor))
    main[-1] = main[-1] if abs(main[-1]) > least else least

    def solve(right: np.ndarray) -> np.ndarray:
        b = right.tolist()
        for i, (swap, factor) in enumerate(steps):
            if swap:
                b[i], b[i + 1] = b[i + 1], b[i]
            b[i + 1] -= factor * b[i]
        for i in range(n - 1, -1, -1):
            after = upper[i] * b[i + 1] if i + 1 < n else 0.0
            after += second[i] * b[i + 2] if i + 2 < n else 0.0
            b[i] = (b[i] - after) / main[i]
        return np.array(b)

    return solve


def vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A unit eigenvector per value (falling), by inverse iteration; those of a cluster are kept at right angles."""
    size = float(np.abs(diagonal).max(initial=0) + 2 * np.abs(off).max(initial=0)) or 1.0
    rng, out, first, shift = np.random.default_rng(11), np.zeros((len(values), len(diagonal))), 0, math.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * size:
            first = j
        shift = min(float(value), shift - 10 * _EPS * size)  # equal values are taken a little apart
        solve = _solver(diagonal, off, shift, _EPS * size)
        x = rng.uniform(-1, 1, len(diagonal))
        for _ in range(6):
            x = solve(x / np.abs(x).max())
            for _ in range(2):
                x -= out[first:j].T @ (out[first:j] @ x)
            x /= np.linalg.norm(x)
        out[j] = x
    return out


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, and a unit eigenvector for each as a row."""
    count, size = min(count, len(matrix)), float(np.abs(matrix).max(initial=0))
    if not count or not size:
        return np.zeros(0), np.zeros((0, len(matrix)))
    diagonal, off, mirrors = tridiagonal(matrix / size)
    values = largest(diagonal, off, count)
    made = vectors(diagonal, off, values)
    for k in range(len(mirrors) - 1, -1, -1):
        if mirrors[k] is not None:
            part = made[:, k + 1 :]
            part -= 2 * np.outer(part @ mirrors[k], mirrors[k])
    return values * size, made


@dataclass
class Model:
    """What whitening needs for vectors of one length."""

    n: int
    sums: np.ndarray  # exact, per dimension
    values: np.ndarray  # eigenvalues, falling
    components: np.ndarray  # a row for each
    trace: float
    identity_error: float = 0.0

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.sums / self.n) @ (self.components / np.sqrt(self.values)[:, None]).T


def fixed_point(embeddings: DataFrame) -> DataFrame:
    """``vec_id`` and ``x``, the entries as whole numbers, of the rows that take part.

    Left out are vectors that are null or empty or hold an entry that is null,
    not finite, or too large for a long once scaled.
    """
    given = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fits = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) < float(2**63)))
    whole = given.where(F.col("v").isNotNull() & (F.size("v") > 0) & fits)
    return whole.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def _blocks(column: pa.Array):
    """Rows of one length as a matrix, with their places, a few thousand at a time."""
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        places = np.flatnonzero(lengths == length)
        for some in np.array_split(places, math.ceil(len(places) / BLOCK)):
            part = column.take(pa.array(some))
            yield some, part.flatten().to_numpy(zero_copy_only=False).reshape(len(some), int(length))


def _totals(fit: DataFrame, kind: str, function) -> np.ndarray:
    """The sum over all blocks of rows of ``function(block)``, a flat array: summed per task, then by place."""
    schema = f"place int, value {kind}"

    def run(batches):
        total = None
        for batch in batches:
            for _, x in _blocks(batch.column(0)):
                part = function(x)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["place", "value"])

    summed = fit.select("x").mapInArrow(run, schema).groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    return summed.sort_by("place").column("value").to_numpy()


def _covariance(fit: DataFrame, n: int, mean: np.ndarray, project=None) -> np.ndarray:
    """Products of centred entries over the rows of ``fit``, divided by their number; ``project`` comes first."""
    upper = np.triu_indices(len(mean))

    def products(x: np.ndarray) -> np.ndarray:
        off = (x if project is None else project(x)) - mean
        return (off.T @ off)[upper]

    out = np.zeros((len(mean), len(mean)))
    out[upper] = _totals(fit, "double", products) / n
    return np.triu(out) + np.triu(out, 1).T


def fit_models(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model per vector length, over the distinct vectors of ``rows`` (see ``fixed_point``).

    Only totals reach the driver: per length a number per dimension, a square
    of that width, and a square as wide as the components.
    """
    distinct = stored(rows.select("x").distinct(), "distinct-vectors")
    models = {}
    for row in distinct.groupBy(F.size("x").alias("length")).count().collect():
        n, fit = row["count"], distinct.where(F.size("x") == row["length"])
        sums = _totals(fit, "long", lambda x: x.sum(0))
        covariance = _covariance(fit, n, sums / n)
        values, found = leading(covariance, components)
        real = values > len(sums) * _EPS * max(float(values.max(initial=0)), float((sums / n).max(initial=0)) ** 2 * _EPS)
        model = Model(n, sums, values[real], found[real], float(np.trace(covariance)))
        if real.any():
            mean = _totals(fit, "double", lambda x, m=model: m.apply(x).sum(0)) / n
            off = _covariance(fit, n, mean, model.apply) - np.eye(len(mean))
            model.identity_error = float(np.abs(off).max())
        models[row["length"]] = model
    return models


WHITENED = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, eigenvalue double, explained double, identity_error double"


def _deviation(x: np.ndarray, model: Model) -> pa.Array:
    """Sum over dimensions of (n x - sum)^2 per row, exact at any size that 38 digits hold."""
    reach = model.n * int(np.abs(x.astype(float)).max(initial=0) + 1) + int(np.abs(model.sums.astype(float)).max(initial=0) + 1)
    if reach * reach * x.shape[1] < 2**63:
        off = model.n * x - model.sums
        return pa.array((off * off).sum(1)).cast(pa.decimal128(38, 0))
    off = model.n * x.astype(object) - model.sums.astype(object)
    return pa.array([int(v) if v < 10**38 else None for v in (off * off).sum(1)], pa.decimal128(38, 0))


def whiten(embeddings: DataFrame, components: int = COMPONENTS, models: dict[int, Model] | None = None) -> DataFrame:
    """Every row's whitened components, a row for each.

    The model is fitted on each distinct vector once, all of them, unless
    ``models`` brings one.  Rows named at ``fixed_point`` take no part; a null
    id stays null, repeated rows are all kept, other columns are not read.
    Vectors of different lengths have a model for each length.  Components
    without variance are left out, so a table that holds only one vector, like
    an empty one, gives no rows.  ``deviation`` is null beyond 38 digits.
    Vectors may be of any length whose square matrix the driver can hold.
    """
    spark = embeddings.sparkSession
    rows = fixed_point(embeddings)
    known = spark.sparkContext.broadcast(fit_models(rows, components) if models is None else models)

    def run(batches):
        for batch in batches:
            ids = batch.column("vec_id")
            for places, x in _blocks(batch.column("x")):
                model = known.value.get(x.shape[1])
                k = 0 if model is None else len(model.values)
                if not k:
                    continue
                each = np.repeat(np.arange(len(x)), k)
                columns = [
                    ids.take(pa.array(places)).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), model.n)),
                    _deviation(x, model).take(pa.array(each)),
                    pa.array(model.apply(x).ravel()),
                    pa.array(np.tile(model.values, len(x))),
                    pa.array(np.tile(model.values / model.trace, len(x))),
                    pa.array(np.full(len(each), model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [part.split()[0] for part in WHITENED.split(", ")]
    return rows.mapInArrow(run, WHITENED)


def whitened_rows(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``whiten`` with the deviation as a long, null where it needs more digits than a long has."""
    made = whiten(embeddings, components).withColumn("deviation", F.expr("try_cast(deviation AS long)"))
    return made.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
