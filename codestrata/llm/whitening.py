"""Whitening of embeddings from exact second moments of fixed-point vectors.

Entries become integers, ``floor(scale * c)``. Shifted to start at zero, each dimension is cut
into bit planes, and a plane of many rows is packed into 64-bit words. The cross-product of two
dimensions is the sum, over pairs of their planes, of the number of rows with both bits, times
the two weights: an AND and a population count. The sums are exact, so centring is done on
integers, and only the final covariance becomes floating point for the eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm import common

common.ship(__name__)

SCALE = 256.0
COMPONENTS = 4
# Rows whose planes are crossed at a time.
BLOCK_ROWS = 1 << 14
# An eigenvalue below this share of the largest one counts as zero.
NO_SPREAD = 1e-13
EXACT = "decimal(38,0)"


def fixed_point(vectors: pa.Array, scale: float) -> list[bytes | None]:
    """Vectors as little-endian longs; none for null vectors and those with odd entries.

    Products beyond the range of a long become its ends.
    """
    lists = pc.cast(vectors, pa.large_list(pa.float64()))
    values = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    ends = np.cumsum(lengths)
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(values))])  # a null entry reads as nan
    clean = odd[ends] == odd[ends - lengths]
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.floor(values * scale)
        x = np.where(whole >= 2.0**63, 2**63 - 1,
                     np.clip(np.nan_to_num(whole), -(2.0**63), 2.0**63 - 1024).astype(np.int64))
    data = x.astype("<i8").tobytes()
    there = vectors.is_valid().to_numpy(zero_copy_only=False)
    return [
        data[8 * (end - n) : 8 * end] if ok else None
        for end, n, ok in zip(ends.tolist(), lengths.tolist(), clean & there, strict=True)
    ]


def fixed_vectors(frame: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """Rows ``id, x`` of the vectors that take part, ``x`` holding longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array(fixed_point(batch.column("vector"), scale), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), x], ["id", "x"]).filter(
                x.is_valid()
            )

    rows = frame.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    return rows.mapInArrow(run, "id long, x binary")


def matrix(x: pa.Array, dimensions: int) -> np.ndarray:
    """Longs of equally long vectors, one row each."""
    data = b"".join(x.to_pylist())
    return np.frombuffer(data, "<i8").reshape(len(x), dimensions)


def planes(x: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Least entry of each dimension, bits of each one's excess, and the packed bit planes."""
    low = x.min(axis=0)
    shifted = x.astype(np.uint64) - low.astype(np.uint64)  # right modulo 2**64
    bits = np.array([int(v).bit_length() for v in shifted.max(axis=0)], np.int64)
    words = -(-len(x) // 64)
    packed = np.zeros((int(bits.sum()), words), np.uint64)
    row, plane = 0, np.zeros(words * 64, bool)
    for column, count in zip(shifted.T, bits.tolist(), strict=True):
        for bit in range(count):
            plane[: len(x)] = column >> np.uint64(bit) & np.uint64(1)
            packed[row] = np.packbits(plane, bitorder="little").view(np.uint64)
            row += 1
    return [int(v) for v in low], bits, packed


def scatter(x: np.ndarray) -> tuple[list[int], dict[tuple[int, int], int]]:
    """Sums of each dimension and of the products of every two, exact, from bit planes."""
    n, (low, bits, packed) = len(x), planes(x)
    first = np.concatenate([[0], np.cumsum(bits)]).tolist()
    owner = np.repeat(np.arange(len(bits)), bits)
    # Python integers, so that no sum overflows.
    weight = np.array([1 << b for count in bits.tolist() for b in range(count)], object)
    d = len(bits)

    def by_dimension(values: np.ndarray, start: int) -> list[int]:
        totals = [0] * d
        for dimension, value in zip(owner[start:].tolist(), values.tolist(), strict=True):
            totals[dimension] += value
        return totals

    ones = np.bitwise_count(packed).sum(axis=1, dtype=np.int64).astype(object)
    excess = by_dimension(ones * weight, 0)
    products = {}
    for i in range(d):
        start = first[i]
        crossed = np.zeros(len(packed) - start, object)
        for row in range(start, first[i + 1]):
            both = np.bitwise_count(packed[start:] & packed[row]).sum(axis=1, dtype=np.int64)
            crossed = crossed + both.astype(object) * weight[row]
        totals = by_dimension(crossed * weight[start:], start)
        for j in range(i, d):
            # Back from the excess over the least entries.
            products[i, j] = (totals[j] + low[i] * excess[j] + low[j] * excess[i]
                              + n * low[i] * low[j])
    return [s + n * m for s, m in zip(excess, low, strict=True)], products


def moments(vectors: DataFrame, dimensions: int) -> tuple[int, list[int], list[list[int]]]:
    """Number of rows of ``vectors(x)``, sums by dimension, and sums of products.

    Tasks add up their blocks; what reaches the driver is one number for each two dimensions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, [0] * dimensions, {}
        for batch in batches:
            x = matrix(batch.column("x"), dimensions)
            for begin in range(0, len(x), BLOCK_ROWS):
                block = x[begin : begin + BLOCK_ROWS]
                own, crossed = scatter(block)
                n += len(block)
                sums = [a + b for a, b in zip(sums, own, strict=True)]
                products = {key: products.get(key, 0) + v for key, v in crossed.items()}
        if n:
            keys = [(-1, -1), *((-1, i) for i in range(dimensions)), *products]
            values = [n, *sums, *products.values()]
            # A sum is sent in parts of 2**60, as a column of decimals ends at 38 digits.
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in keys], pa.int32()),
                 pa.array([j for _, j in keys], pa.int32()),
                 pa.array([v % 2**60 for v in values], pa.int64()),
                 pa.array([(v >> 60) % 2**60 for v in values], pa.int64()),
                 pa.array([v >> 120 for v in values], pa.int64())],
                ["i", "j", "low", "middle", "high"],
            )

    parts = vectors.mapInArrow(run, "i int, j int, low long, middle long, high long")
    rows = parts.groupBy("i", "j").agg(
        *[F.sum(F.col(c).cast(EXACT)).alias(c) for c in ("low", "middle", "high")]
    ).collect()
    total = {(r.i, r.j): int(r.low) + (int(r.middle) << 60) + (int(r.high) << 120) for r in rows}
    cross = [[total.get((min(i, j), max(i, j)), 0) for j in range(dimensions)]
             for i in range(dimensions)]
    return (total.get((-1, -1), 0), [total.get((-1, i), 0) for i in range(dimensions)], cross)


@dataclass(frozen=True)
class Whitening:
    """Rows of the fit, sums by dimension, and the first components with their variances."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    variances: np.ndarray
    trace: float


def fitted(n: int, sums: list[int], cross: list[list[int]], components: int) -> Whitening:
    """Eigenvectors of the covariance, which is centred as integers and then divided."""
    d = len(sums)
    centred = [[n * cross[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    covariance = np.array([[float(Fraction(v, n * n)) for v in row] for row in centred])
    values, columns = np.linalg.eigh(covariance.reshape(d, d))
    order = np.argsort(-values, kind="stable")[:components]
    vectors = columns[:, order]
    # One sign for all rows, the same in every run: the largest entry is positive.
    strongest = np.abs(vectors).argmax(axis=0) if d else []
    vectors = vectors * np.where(vectors[strongest, np.arange(len(order))] < 0, -1.0, 1.0)
    trace = float(Fraction(sum(centred[i][i] for i in range(d)), n * n))
    return Whitening(n, sums, vectors, values[order], trace)


def project(x: np.ndarray, fit: Whitening) -> np.ndarray:
    """Whitened values, a column for each component; 0 where a component has no spread."""
    centred = x - np.array([s // fit.n for s in fit.sums], np.int64)
    centred = centred - np.array([s % fit.n / fit.n for s in fit.sums])
    spread = fit.variances > NO_SPREAD * max(fit.variances.max(initial=0.0), 1e-300)
    return np.where(
        spread, centred @ fit.vectors / np.sqrt(np.where(spread, fit.variances, 1.0)), 0.0
    )


def whitened_rows(vectors: DataFrame, fit: Whitening) -> DataFrame:
    """Rows ``id, whitened, deviation`` for rows ``id, x``."""
    n, d = fit.n, len(fit.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), d)
            values = project(x, fit)
            # Exact: as longs where they cannot overflow, else as whole Python numbers.
            most = max((max(abs(int(v)) for v in (x.min(initial=0), x.max(initial=0))) * n
                        + max(map(abs, fit.sums), default=0)), 1)
            small = most * most * max(d, 1) < 2**63
            exact = x.astype(np.int64 if small else object) * n - np.array(
                fit.sums, np.int64 if small else object
            )
            deviation = (exact * exact).sum(axis=1) if d else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(list(values), pa.list_(pa.float64())),
                 pa.array([str(v) for v in deviation.tolist()])],
                ["id", "whitened", "deviation"],
            )

    return vectors.mapInArrow(run, "id long, whitened array<double>, deviation string")


def whiten(
    frame: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: float = SCALE, components: int = COMPONENTS,
) -> DataFrame:
    """Rows ``id, n, deviation, whitened, explained, identity_error``, one for each vector.

    The fit uses each different fixed-point vector once; ``whitened`` and ``explained`` are
    arrays by component, from the largest variance on, and ``deviation`` is exact text. Null
    vectors and vectors with a null or non-finite entry have no row; neither have vectors of
    another length than most have (of equally common lengths the shortest counts). A component
    without spread is 0 everywhere, so its identity error is 1. Repeated rows stay, a null id
    stays null, and a table without vectors gives no rows. No other column is read.
    """
    fixed = common.staged(fixed_vectors(frame, id_col, vector_col, scale), "fixed")
    length = F.octet_length("x")
    common_length = fixed.groupBy(length.alias("bytes")).count().orderBy(
        F.desc("count"), "bytes"
    ).first()
    size = common_length["bytes"] if common_length else 0
    fixed = fixed.where(length == size)
    distinct = common.staged(fixed.select("x").distinct(), "distinct")
    n, sums, cross = moments(distinct, size // 8)
    fit = fitted(n, sums, cross, components) if n else Whitening(
        1, [], np.zeros((0, 0)), np.zeros(0), 0.0
    )
    found = len(fit.variances)
    own = whitened_rows(distinct.select(F.lit(None).cast("long").alias("id"), "x"), fit)
    pairs = [(a, b) for a in range(found) for b in range(a, found)]
    error = own.agg(F.lit(0.0).alias("none"), *[
        F.abs(F.covar_pop(F.col("whitened")[a], F.col("whitened")[b]) - float(a == b)).alias(
            f"e{a}_{b}")
        for a, b in pairs
    ]).first()
    explained = [float(v / fit.trace) if fit.trace else 0.0 for v in fit.variances]
    return whitened_rows(fixed, fit).select(
        "id", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.array(*map(F.lit, explained)).cast("array<double>").alias("explained"),
        F.lit(max(v or 0.0 for v in error)).alias("identity_error"),
    )
