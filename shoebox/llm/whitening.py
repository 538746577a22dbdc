"""Embedding whitening by cyclic Jacobi rotations (operator 13).

1. Sums: every task adds its vectors to one row of integers per dimension; these rows are summed exactly.
2. Scatter: with the means known, every task centres its vectors and adds up their products as a d x d matrix; the matrices are summed row by
   row. Centred before multiplying, so a large common offset cancels nothing.
3. The driver, which holds one d x d matrix whatever the number of vectors, applies rotations to each pair of dimensions in turn
   until all off-diagonal entries vanish. Jacobi rotations find small eigenvalues with small relative error, where methods that first reduce the
   matrix to three diagonals only have an error relative to the largest.
4. The eigenvectors over the square roots of their eigenvalues are broadcast, and every vector is projected. Nothing is shuffled but the
   partial sums of 1 and 2 (d rows a task).

Entries c are taken as integers x = floor(scale * c). Deviations n * x - sum are exact integers, so the centred values carry no more than
one rounding; a constant added to every x (the query's 1,000,000) cancels in them exactly, which is why none is added.

Defined cases: vectors that are null or have null or non-finite entries are dropped, as are empty vectors and those that are not of the
commonest length (of equally common lengths the largest); repeated rows count each; components without variance (an eigenvalue below 1e-12 of the trace, as
for a single vector or constant dimensions) are not returned; of equal eigenvalues any orthonormal vectors do; null ids stay null; an
empty table gives an empty result; an entry beyond 2 ** 40 after scaling is an error; a deviation beyond a long is null;
other columns are not read. (Texts do not occur.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .vectors import floored, list_array, matrix, usable

COMPONENTS, SCALE = 32, 64
BOUND = 1 << 40


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, _, lengths, good = usable(batch.column(1))
        found, n = np.unique(lengths[good], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n)], ["length", "n"])


def _sums(dim: int, scale: int):
    """One row per dimension and task: the count and the sum of the scaled entries, without the offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, dtype=object)
        for batch in batches:
            rows, x = matrix(batch.column(1), dim)
            n, total = n + len(rows), total + floored(x, scale, BOUND).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array([n] * dim, pa.int64()), pa.array([str(t) for t in total])], ["j", "n", "s"])

    return run


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n * x - sums exactly, as integers of any size if need be; the same over n)."""
    small = n * int(np.abs(x).max(initial=0)) + max(abs(int(s)) for s in sums) < 1 << 62
    deviation = n * x - sums.astype(np.int64) if small else n * x.astype(object) - sums
    return deviation, (deviation / n).astype(np.float64)


def _scatter(dim: int, centred):
    """One row per dimension and task of the summed products of centred vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dim, dim)), 0
        for batch in batches:
            y = centred(batch)
            total, n = total + y.T @ y, n + len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), list_array(total)], ["j", "row"])

    return run


def _summed(rows: DataFrame, dim: int) -> np.ndarray:
    """The d x d sum of (j, row) rows."""
    out = np.zeros((dim, dim))
    for r in rows.groupBy("j").agg(*[F.sum(F.col("row")[i]) for i in range(dim)]).collect():  # d rows
        out[r[0]] = r[1:]
    return (out + out.T) / 2


def jacobi(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(falling eigenvalues, unit eigenvectors as columns) of a symmetric matrix, by cyclic rotations."""
    a, v = np.array(a, dtype=np.float64), np.eye(len(a))
    for _ in range(sweeps):
        rotated = False
        for p in range(len(a) - 1):
            for q in range(p + 1, len(a)):
                # Done once an entry is nothing beside both of its diagonal entries: the test that keeps small eigenvalues accurate.
                if abs(a[p, q]) <= 1e-16 * np.sqrt(abs(a[p, p] * a[q, q])) or a[p, q] == 0:
                    continue
                rotated = True
                theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = (1 if theta >= 0 else -1) / (abs(theta) + np.hypot(theta, 1))
                c = 1 / np.hypot(t, 1)
                turn = np.array([[c, t * c], [-t * c, c]])
                pq, both = a[p, q], [p, q]
                app, aqq = a[p, p] - t * pq, a[q, q] + t * pq
                a[:, both] = a[:, both] @ turn
                a[both, :] = a[:, both].T
                a[p, p], a[q, q], a[p, q], a[q, p] = app, aqq, 0.0, 0.0
                v[:, both] = v[:, both] @ turn
        if not rotated:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[:, order]


class Whitening:
    """A fitted whitening: n, the sums, eigenvalues and the projection (a column per component)."""

    def __init__(self, n: int, sums: np.ndarray, values: np.ndarray, vectors: np.ndarray, trace: float, components: int, scale: int):
        self.n, self.sums, self.trace, self.scale = n, sums, trace, scale
        k = min(components, int((values > 1e-12 * trace).sum())) if trace > 0 else 0
        self.values, self.projection = values[:k], vectors[:, :k] / np.sqrt(values[:k])


def fitted(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> Whitening | None:
    """The whitening of a table of (id, v array<double>); None for no vectors."""
    lengths = vectors.mapInArrow(_lengths, "length long, n long").where("length > 0").groupBy("length").agg(F.sum("n").alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    if not most:
        return None
    dim = most[0]["length"]
    rows = vectors.mapInArrow(_sums(dim, scale), "j long, n long, s string").groupBy("j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # d rows
    n, sums = int(rows[0]["n"]), np.array([int(r["s"]) for r in sorted(rows)], dtype=object)

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        return _centred(floored(matrix(batch.column(1), dim)[1], scale, BOUND), n, sums)[1]

    covariance = _summed(vectors.mapInArrow(_scatter(dim, centred), "j long, row array<double>"), dim) / n
    values, axes = jacobi(covariance)
    return Whitening(n, sums, values, axes, float(np.trace(covariance)), components, scale)


def identity_error(vectors: DataFrame, fit: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over all vectors."""
    dim, k = len(fit.sums), len(fit.values)
    if not k:
        return 0.0

    def whitened(batch: pa.RecordBatch) -> np.ndarray:  # their mean is zero: the centred vectors add up to zero
        return _centred(floored(matrix(batch.column(1), dim)[1], fit.scale, BOUND), fit.n, fit.sums)[1] @ fit.projection

    covariance = _summed(vectors.mapInArrow(_scatter(k, whitened), "j long, row array<double>"), k) / fit.n
    return float(np.abs(covariance - np.eye(k)).max())


_OUT = "id long, component int, deviation long, whitened double, explained double"


def whitened(vectors: DataFrame, fit: Whitening) -> DataFrame:
    """(id, component from 1, deviation, whitened, explained) of every vector and component."""
    dim, k = len(fit.sums), len(fit.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = matrix(batch.column(1), dim)
            for a in range(0, len(rows), 2048):
                own = rows[a : a + 2048]
                whole, y = _centred(floored(x[a : a + 2048], fit.scale, BOUND), fit.n, fit.sums)
                if whole.dtype == object or int(np.abs(whole).max(initial=0)) ** 2 * dim >= 1 << 63:
                    sizes = [int(s) for s in (whole.astype(object) ** 2).sum(axis=1)]
                    size = pa.array([s if s < 1 << 63 else None for s in sizes], pa.int64())
                else:
                    size = pa.array((whole**2).sum(axis=1))
                each = pa.array(np.repeat(np.arange(len(own)), k))
                columns = [batch.column(0).take(pa.array(own)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(own))), size.take(each), pa.array((y @ fit.projection).reshape(-1)), pa.array(np.tile(fit.values / fit.trace, len(own)))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "component", "deviation", "whitened", "explained"])

    return vectors.mapInArrow(run, _OUT)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    fit = fitted(vectors)
    if fit is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(vectors, fit)
    return whitened(vectors, fit).select(F.col("id").alias("vec_id"), "component", F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))
