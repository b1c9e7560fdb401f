"""Nearest neighbours by collision counting over query-centred windows.

Vectors are projected on random lines, and each line keeps its vectors as a sorted array. A
query looks at the window around its own place on every line, and the windows of all lines
are widened together, round by round (virtual rehashing). A vector that falls into enough
windows is verified with the exact inner product. The search of a block of vectors ends
when enough of them are verified.

Nearness by inner product becomes nearness by distance when one coordinate is added to each
vector that brings all of a block to the same length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codestrata.llm import common

common.ship(__name__)

LINES = 64  # fewer than 256
# Share of the lines on which a vector must fall into the window to be verified.
COLLISIONS = 0.6
# A block's search ends when this share of its vectors is verified, and k at least.
VERIFIED = 0.3
# The first half-width of a window, as a share of a block's length, and its growth.
WIDTH, GROWTH = 1.1, 1.15
# Vectors (fewer than 65536), and queries, that meet in one task's step.
BLOCK = 4096
QUERY_BLOCK = 2048
SEED = 29


class SortedLines:
    """Sorted projections of a block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = SEED):
        self.ids, self.vectors = ids, vectors
        squares = (vectors * vectors).sum(axis=1)
        self.length = float(np.sqrt(squares.max()))
        filled = np.sqrt(np.maximum(self.length**2 - squares, 0))
        self.lines = np.random.default_rng(seed).normal(size=(LINES, vectors.shape[1] + 1))
        places = self.lines @ np.column_stack([vectors, filled]).T
        order = np.argsort(places, axis=1, kind="stable")
        self.places = np.take_along_axis(places, order, axis=1)
        # Each vector's place in the sorted array of each line.
        self.ranks = np.empty(order.shape, np.uint16)
        np.put_along_axis(self.ranks, order, np.arange(len(ids), dtype=np.uint16)[None], axis=1)

    def centres(self, queries: np.ndarray) -> np.ndarray:
        """Places of queries, brought to the block's length, on each line."""
        lengths = np.sqrt((queries * queries).sum(axis=1))
        return self.lines[:, :-1] @ (queries * (self.length / lengths)[:, None]).T

    def candidates(self, centres: np.ndarray, wanted: int) -> np.ndarray:
        """Rows found in the windows of enough lines, for each query: lists of rows."""
        found: list[np.ndarray | None] = [None] * centres.shape[1]
        needed, width = int(np.ceil(COLLISIONS * LINES)), WIDTH * self.length
        while any(rows is None for rows in found):
            lower, upper = (
                np.stack([np.searchsorted(p, c + reach, side)
                          for p, c in zip(self.places, centres, strict=True)])
                for reach, side in ((-width, "left"), (width, "right"))
            )
            for query, rows in enumerate(found):
                if rows is not None:
                    continue
                # Ranks below the window wrap around to large numbers.
                first = lower[:, query, None].astype(np.uint16)
                span = (upper - lower)[:, query, None].astype(np.uint16)
                hits = ((self.ranks - first) < span).sum(axis=0, dtype=np.uint8)
                over = hits >= needed
                if np.count_nonzero(over) >= wanted:
                    found[query] = np.flatnonzero(over)
            width *= GROWTH
        return found

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """Query ids, ids and scores of the k best verified rows of every query."""
        # The query itself may be in the block, so one more than k is wanted.
        wanted = min(len(self.ids), max(k + 1, int(VERIFIED * len(self.ids))))
        out: tuple[list, list, list] = ([], [], [])
        for begin in range(0, len(queries), 256):
            chunk = queries[begin : begin + 256]
            for offset, rows in enumerate(self.candidates(self.centres(chunk), wanted)):
                own = query_ids[begin + offset]
                rows = rows[self.ids[rows] != own]
                # Sums along rows are the same for equal vectors wherever they stand.
                scores = np.einsum("ij,j->i", self.vectors[rows], chunk[offset])
                best = np.lexsort((self.ids[rows], -scores))[:k]
                out[0].append(np.full(len(best), own))
                out[1].append(self.ids[rows][best])
                out[2].append(scores[best])
        return tuple(np.concatenate(part) if part else np.zeros(0) for part in out)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows ``id, vector`` (doubles) that can be searched, one for every id.

    Ids and vectors that are null, and vectors that are empty, zero or hold null or
    non-finite components, take no part. Of several vectors with one id the first in
    array order stands for it.
    """
    array = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), array.alias("vector"))
    rows = rows.where(
        F.col("id").isNotNull()
        & F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    return rows.groupBy("id").agg(F.min("vector").alias("vector"))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Vectors of one dimension packed into rows ``dim, part, ids, data`` of bounded size."""

    def pack(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            ids = batch.column("id").to_numpy()
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                data = batch.column("vector").take(pa.array(own)).flatten().to_numpy()
                data = data.reshape(len(own), dim)
                out: dict[str, list] = {"dim": [], "part": [], "ids": [], "data": []}
                for begin in range(0, len(own), size):
                    chosen = ids[own[begin : begin + size]]
                    out["dim"].append(int(dim))
                    out["part"].append(int(chosen[0] * 2654435761 % (1 << 31)))
                    out["ids"].append(chosen.tobytes())
                    out["data"].append(data[begin : begin + size].tobytes())
                yield pa.RecordBatch.from_pydict(
                    out, pa.schema([("dim", pa.int32()), ("part", pa.int64()),
                                    ("ids", pa.binary()), ("data", pa.binary())])
                )

    sized = rows.select(F.size("vector").alias("dim"), "id", "vector")
    return sized.mapInArrow(pack, "dim int, part long, ids binary, data binary")


def nearest(
    vectors: DataFrame, every: int, k: int, id_col: str = "vec_id",
    vector_col: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """Rows ``query_id, rank, id, score``: k neighbours of each id divisible by ``every``.

    Vectors are packed into blocks and every block of queries meets every block of
    vectors of the same dimension, in a task step of bounded size; a query's best rows of
    all blocks are then ranked by score, ties by the smaller id. A query is no neighbour
    of itself, and has all others as neighbours where there are fewer than k. An empty
    table gives no rows; other columns are not read.
    """
    rows = common.staged(usable(vectors, id_col, vector_col), "vectors")
    blocks = common.staged(_blocks(rows, block), "blocks")
    asked = rows.where(F.pmod("id", F.lit(every)) == 0)
    asked = common.staged(_blocks(asked, query_block), "asked")
    n_blocks, n_asked = max(1, blocks.count()), max(1, asked.count())
    # Each block has one place of the grid on its own side and meets all on the other.
    left = blocks.select(
        "dim", F.pmod("part", F.lit(n_blocks)).alias("row"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_asked - 1).cast("long"))).alias("column"),
        "ids", "data",
    )
    right = asked.select(
        "dim",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("row"),
        F.pmod("part", F.lit(n_asked)).alias("column"), "ids", "data",
    )

    def search(left_rows: pa.Table, right_rows: pa.Table) -> pa.Table:
        out = []
        for ids, vectors in _unpacked(left_rows):
            lines = SortedLines(ids, vectors)
            out += [lines.nearest(*own, k) for own in _unpacked(right_rows)]
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table(
            [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)],
            names=["query_id", "id", "score"],
        )

    grid = ["dim", "row", "column"]
    found = (
        left.groupBy(*grid)
        .cogroup(right.groupBy(*grid))
        .applyInArrow(search, "query_id long, id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")


def _unpacked(rows: pa.Table):
    for row in rows.to_pylist():
        ids = np.frombuffer(row["ids"], np.int64)
        yield ids, np.frombuffer(row["data"], np.float64).reshape(len(ids), row["dim"])
