"""Whitening of vectors: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

1. Components become integers, floor(`factor` * x) + `shift`. Their sums over all vectors are exact.
2. The scatter of the centred vectors is summed in Spark: each task adds up one square matrix, cells meet by number.
3. Pivoted Cholesky writes the covariance V as L L' after a permutation and stops at its rank. One-sided Jacobi rotates
   pairs of columns of L until all are orthogonal: with L J = U S, V is U S^2 U', so squared column norms are the
   eigenvalues and normalised columns the eigenvectors. V itself is not diagonalised, which keeps small eigenvalues exact.
4. Every vector, centred and projected, is divided by the root of the eigenvalue. The covariance of the results is
   computed from the written rows and held against the identity.

What goes through the driver is one square of the dimension, whatever the number of rows. Rows never shuffle, so no key
or group can be hot; a vector is only as large as its dimension.

A vector that is null or holds a null, NaN or infinite component is dropped. Shorter vectors count as filled up with zeros.
Components are cut to +-2^52 after the factor, the integers that a double holds exactly. Components of the result
beyond the rank of V (fewer vectors than dimensions, equal vectors) have the eigenvalue 0: `whitened` is null there,
`explained` 0, and the check leaves them out; a single vector has no others, and its `identity_error` is 0. `deviation`
is null where it does not fit into a long. A component's largest entry is positive. Rows without a key and rows that
repeat are each treated like any other, an empty table gives an empty one. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.llm.common import written

FACTOR, SHIFT, MOST = 64, 1_000_000, 32
LARGEST = float(1 << 52)
#: Rows whose integers are added without overflow: 2^10 * 2^53 fits a long.
ADD_ROWS = 512
#: A pivot below this share of the largest one counts as zero; a rotation below it is not needed.
ZERO = 1e-14
SWEEPS = 60


def integer_rows(column: pa.Array, width: int, factor: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows stay, and their integers as a matrix of `width` columns."""
    size = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64), nan=-1).astype(np.int64)
    there = size >= 0
    long = np.where(there, size, 0)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(size)), long)
    there[row[~np.isfinite(values)]] = False
    place = np.arange(len(values)) - np.repeat(np.cumsum(long) - long, long)
    matrix = np.zeros((len(size), width))
    matrix[row, place] = np.nan_to_num(values, nan=0, posinf=0, neginf=0)
    return there, np.clip(np.floor(matrix[there] * factor), -LARGEST, LARGEST).astype(np.int64) + shift


def cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pivoted Cholesky: the order of rows and columns, and L with as many columns as the matrix has rank."""
    rest = matrix.astype(np.float64).copy()
    d = len(rest)
    order, factor = np.arange(d), np.zeros((d, d))
    most = float(rest.diagonal().max(initial=0))
    for k in range(d):
        p = k + int(np.argmax(rest.diagonal()[k:]))
        if rest[p, p] <= most * ZERO * d or rest[p, p] <= 0:
            return order, factor[:, :k]
        for table in (rest, factor):
            table[[k, p]] = table[[p, k]]
        rest[:, [k, p]] = rest[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        factor[k, k] = math.sqrt(rest[k, k])
        factor[k + 1:, k] = rest[k + 1:, k] / factor[k, k]
        rest[k + 1:, k + 1:] -= np.outer(factor[k + 1:, k], factor[k + 1:, k])
    return order, factor


def rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of columns so that every two meet once and the pairs of one round share none."""
    ring = list(range(n + n % 2))
    out = []
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[:len(ring) // 2], ring[::-1], strict=False) if a < n and b < n]
        out.append((np.array([a for a, _ in pairs], np.int64), np.array([b for _, b in pairs], np.int64)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of factor times its transpose: columns of the factor are
    rotated until every two are orthogonal."""
    columns = factor.copy()
    meetings = rounds(columns.shape[1])
    for _ in range(SWEEPS):
        turned = False
        for p, q in meetings:
            a, b = columns[:, p], columns[:, q]
            alpha, beta, gamma = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            turn = np.abs(gamma) > ZERO * np.sqrt(alpha * beta)
            if not turn.any():
                continue
            turned = True
            zeta = (beta - alpha)[turn] / (2 * gamma[turn])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            columns[:, p[turn]], columns[:, q[turn]] = c * a[:, turn] - c * t * b[:, turn], c * t * a[:, turn] + c * b[:, turn]
        if not turned:
            break
    values = (columns * columns).sum(0)
    by_value = np.argsort(-values, kind="stable")
    values, columns = values[by_value], columns[:, by_value]
    return values, columns / np.sqrt(values)


def components(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors as columns; as many as the rank."""
    order, factor = cholesky(covariance)
    values, vectors = jacobi(factor)
    out = np.empty_like(vectors)
    out[order] = vectors
    if out.size:
        largest = np.abs(out).argmax(axis=0)
        out *= np.sign(out[largest, np.arange(out.shape[1])])
    return values, out


def _summed(parts: DataFrame, cells: int) -> np.ndarray:
    """Cell numbers and partial sums of all tasks, added up to one array; as many rows as cells reach the driver."""
    out = np.zeros(cells)
    for r in parts.groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out[r["cell"]] = r["v"]
    return out


def _cells(total: np.ndarray) -> pa.RecordBatch:
    flat = total.reshape(-1)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["cell", "v"])


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", factor: int = FACTOR, shift: int = SHIFT,
           most: int = MOST) -> DataFrame:
    """Key, `component` (from 1), `n`, `deviation`, `whitened`, `explained` and `identity_error` for each vector and
    each of the first `most` components."""
    spark = df.sparkSession
    vectors = df.select(df[key].alias("key"), df[vector].cast("array<double>").alias("v"))
    kind = vectors.schema["key"].dataType.simpleString()
    width = vectors.filter("v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))").agg(
        F.max(F.size("v"))).first()[0] or 0
    result = f"key {kind}, n long, deviation long, w array<double>"
    columns = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not width:
        return spark.createDataFrame([], columns)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for batch in batches:
            _, x = integer_rows(_usable(batch.column(0), width), width, factor, shift)
            n += len(x)
            for low in range(0, len(x), ADD_ROWS):
                total = [a + b for a, b in zip(total, x[low:low + ADD_ROWS].sum(axis=0).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), pa.array(map(Decimal, [*total, n]), pa.decimal128(38, 0))],
                                         names=["cell", "v"])

    exact = vectors.select("v").mapInArrow(sums, "cell int, v decimal(38,0)").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    found = {r["cell"]: int(r["v"]) for r in exact}
    n = found[width]
    total = [found[i] for i in range(width)]
    # The mean is a whole number and a rest, so that centring loses nothing.
    whole = np.array([s // n for s in total], np.int64)
    rest = np.array([(s % n) / n for s in total])

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - whole).astype(np.float64) - rest

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summed = np.zeros((width, width))
        for batch in batches:
            y = centred(integer_rows(_usable(batch.column(0), width), width, factor, shift)[1])
            summed += y.T @ y
        yield _cells(summed)

    covariance = _summed(vectors.select("v").mapInArrow(scatter, "cell int, v double"), width * width).reshape(width, width) / n
    values, axes = components((covariance + covariance.T) / 2)
    shown = min(most, width)
    rank = min(shown, len(values))
    scaled = axes[:, :rank] / np.sqrt(values[:rank])
    trace = float(covariance.trace())
    fits = (1 << 62) / width

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there, x = integer_rows(_usable(batch.column(1), width), width, factor, shift)
            y = centred(x)
            w = y @ scaled
            if len(y) and float(np.abs(y).max()) * n < math.sqrt(fits):
                apart = (n * (x - whole) - np.array([s % n for s in total], np.int64)) ** 2
                deviation = apart.sum(axis=1).tolist()
            else:
                deviation = [sum((n * a - s) ** 2 for a, s in zip(row, total, strict=True)) for row in x.tolist()]
                deviation = [d if d < 1 << 63 else None for d in deviation]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * rank), pa.array(w.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(there)), pa.array(np.full(len(w), n, np.int64)), pa.array(deviation, pa.int64()), lists],
                names=["key", "n", "deviation", "w"])

    rows = written(vectors.mapInArrow(project, result), "whitened")

    def matrix_of(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), rank)

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summed = np.zeros(rank)
        for batch in batches:
            summed += matrix_of(batch.column(0)).sum(axis=0)
        yield _cells(summed)

    mean = _summed(rows.select("w").mapInArrow(means, "cell int, v double"), rank) / n

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summed = np.zeros((rank, rank))
        for batch in batches:
            y = matrix_of(batch.column(0)) - mean
            summed += y.T @ y
        yield _cells(summed)

    got = _summed(rows.select("w").mapInArrow(spread, "cell int, v double"), rank * rank).reshape(rank, rank) / n
    error = float(np.abs(got - np.eye(rank)).max(initial=0))
    share = [float(values[i] / trace) if i < rank else 0.0 for i in range(shown)]
    number = F.explode(F.sequence(F.lit(1), F.lit(shown)))
    return rows.select("key", number.alias("component"), "n", "deviation", "w").select(
        F.col("key").alias(key), "component", "n", "deviation", F.get("w", F.col("component") - 1).alias("whitened"),
        F.get(F.array(*map(F.lit, share)), F.col("component") - 1).alias("explained"), F.lit(error).alias("identity_error"))


def _usable(column: pa.Array, width: int) -> pa.Array:
    """Rows longer than any finite vector are those to be dropped; they become null."""
    return pa.compute.if_else(pa.compute.greater(pa.compute.list_value_length(column), width), pa.scalar(None, column.type), column)


def op12_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op12_embedding_whitening": op12_embedding_whitening}
ORACLE: dict[str, str] = {}
