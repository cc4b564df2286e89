"""Embedding whitening: exact covariances by polarisation, then principal components of unit variance.

Entries become whole numbers, x = floor(1024 c) + 100000, so that sums are exact. With n vectors and the sums S of each
dimension, y = n x - S is a centred value times n, a whole number too. Tasks add up y_i ** 2 for every dimension and
(y_i + y_j) ** 2 for every pair of dimensions; half of what the variance of a sum exceeds the variances of its two parts
by is their covariance. The matrix has a row and a column a dimension, however many vectors there are, and is all that
the driver sees.

Defined cases: vectors that are null, or hold a null, a NaN, an infinity or an entry of 2 ** 52 or more, are left out,
and so are those whose length is not the commonest one (of equally common ones, the longest). Repeated rows and ids each count
and each get their rows; a null id stays null. Components whose variance is nothing but rounding (rank below 8, all
vectors equal, one vector) are not returned, so such tables and empty ones give fewer rows or none. Columns other than
the id and the vector are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import small_batches, written

#: Whole numbers are floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 1024, 100_000

#: Components that are returned at most.
MOST = 8

#: Rows that are squared at a time, and the bits of a limb: sums of products of two limbs over these rows fit 64 bits.
ROWS, LIMB = 512, 21

#: Totals are sent as whole numbers of 2 ** PART and what is left.
PART = 60


@dataclass(frozen=True)
class Whitening:
    """What is learned: the number of vectors, their sums, and unit eigenvectors as columns with their eigenvalues, largest first."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def whole(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, x array<long>: the fit list, written."""
    entry = F.col("embedding").cast("array<double>")
    fine = F.forall(entry, lambda c: F.coalesce(F.abs(c) < float(1 << 52), F.lit(False)))
    rows = vectors.filter(F.col("embedding").isNotNull() & fine)
    rows = written(rows.select("vec_id", F.transform(entry, lambda c: F.floor(c * scale) + shift).alias("x")), "whole-vectors")
    common = rows.groupBy(F.size("x").alias("length")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "length"))).first()[0]
    return rows.filter(F.size("x") == (common["length"] if common else 0))


def matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of at most ROWS rows with their vectors, the last column, as a matrix."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            yield part, part.column(part.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)


def sums_of(x: np.ndarray) -> np.ndarray:
    """Sums of the columns as Python's whole numbers."""
    return ((x >> 32).sum(axis=0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)


def squares_of(y: np.ndarray) -> np.ndarray:
    """Sums of the squares of each column as Python's whole numbers; y holds 64-bit numbers below 2 ** 62, or Python's."""
    if y.dtype == object:
        return (y * y).sum(axis=0)
    a = np.abs(y)
    if not a.size or a.max() < 1 << 26:
        return (a * a).sum(axis=0).astype(object)
    limbs = [a & ((1 << LIMB) - 1), (a >> LIMB) & ((1 << LIMB) - 1), a >> (2 * LIMB)]
    total = np.zeros(y.shape[1], dtype=object)
    for i, one in enumerate(limbs):
        for j, other in enumerate(limbs):
            total = total + (np.einsum("rc,rc->c", one, other).astype(object) << (LIMB * (i + j)))
    return total


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: in 64 bits where sums of two of them fit 62, else in Python's whole numbers."""
    most = max((int(np.abs(x).max()) if x.size else 0) * n, max(map(abs, sums), default=0))
    if most < 1 << 59:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def totals(rows: DataFrame, dim: int, of) -> dict[int, int]:
    """Adds up what `of` makes of a matrix, an array of whole numbers, over all rows: by place in the array."""
    out = pa.schema([("k", pa.int64()), ("high", pa.decimal128(38, 0)), ("low", pa.decimal128(38, 0))])

    def run(batches):
        total = None
        for _, x in matrices(batches, dim):
            got = of(x)
            total = got if total is None else total + got
        for lo in range(0, 0 if total is None else len(total), 4096):
            part = [int(v) for v in total[lo : lo + 4096]]
            high, low = [Decimal(v >> PART) for v in part], [Decimal(v & ((1 << PART) - 1)) for v in part]
            yield pa.RecordBatch.from_arrays([pa.array(range(lo, lo + len(part)), pa.int64()), pa.array(high, out[1].type), pa.array(low, out[2].type)], schema=out)

    small_batches(rows.sparkSession)
    sums = rows.select("x").mapInArrow(run, "k long, high decimal(38,0), low decimal(38,0)").groupBy("k").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    return {r["k"]: (int(r["high"]) << PART) + int(r["low"]) for r in sums.toLocalIterator()}


def covariance(rows: DataFrame, dim: int, n: int, sums: list[int]) -> np.ndarray:
    """The covariance matrix of x, by polarisation, each entry the nearest double to its exact value."""

    def squares(x):
        y = centred(x, n, sums)
        # Row by row of the upper triangle: the dimension itself, then its sums with those after it.
        parts = [part for i in range(dim) for part in (squares_of(y[:, i : i + 1]), squares_of(y[:, i + 1 :] + y[:, i : i + 1]))]
        return np.concatenate(parts)

    found = totals(rows, dim, squares)
    first = [i * dim - i * (i - 1) // 2 for i in range(dim)]
    matrix = np.zeros((dim, dim))
    for i in range(dim):
        for j in range(i, dim):
            own, other = found[first[i]], found[first[j]]
            matrix[i, j] = matrix[j, i] = own / n**3 if i == j else (found[first[i] + j - i] - own - other) / (2 * n**3)
    return matrix


def fit(rows: DataFrame, most: int = MOST) -> Whitening | None:
    """Learns from the fit list; None where there is nothing to learn from."""
    size = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    n, dim = size[0], size[1] or 0
    if not n or not dim:
        return None
    found = totals(rows, dim, sums_of)
    sums = [found[i] for i in range(dim)]
    matrix = covariance(rows, dim, n, sums)
    values, vectors = np.linalg.eigh(matrix)
    trace = float(np.trace(matrix))
    order = [i for i in np.argsort(-values, kind="stable")[:most] if values[i] > trace * dim * np.finfo(float).eps]
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))]) if order else np.ones(0)
    return Whitening(n, sums, vectors * signs, values[order], trace)


def project(rows: DataFrame, model: Whitening) -> DataFrame:
    """The fit list -> vec_id, deviation decimal(38,0) (null where longer), whitened array<double>, a number a component."""
    out = pa.schema([("vec_id", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64()))])
    n, sums, dim, axes = model.n, model.sums, len(model.sums), model.vectors / np.sqrt(model.values)

    def run(batches):
        for part, x in matrices(batches, dim):
            y = centred(x, n, sums)
            if y.dtype != object and dim * int(np.abs(y).max()) ** 2 >= 1 << 63:
                y = y.astype(object)
            deviation = [Decimal(v) if v < 10**38 else None for v in map(int, (y * y).sum(axis=1))]
            values = (y / n).astype(np.float64) @ axes
            at = pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32())
            whitened = pa.ListArray.from_arrays(at, pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(deviation, out[1].type), whitened], schema=out)

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, "vec_id long, deviation decimal(38,0), whitened array<double>")


def identity_error(projected: DataFrame, k: int) -> float:
    """The largest entry, in size, of the covariance of k whitened components minus the identity."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = projected.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(got, pairs, strict=True))


def whiten(vectors: DataFrame, most: int = MOST) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, component, n, deviation decimal, whitened, explained, identity_error: a row a vector and component."""
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = whole(vectors)
    model = fit(rows, most)
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    projected = written(project(rows, model), "whitened")
    error = identity_error(projected, len(model.values))
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    each = projected.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
