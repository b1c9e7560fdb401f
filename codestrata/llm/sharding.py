"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard has virtual nodes at hashed places of a ring, and a row belongs to the first
node clockwise of its own hash. A full shard passes the rows that overflow on to the next
node clockwise. Capacities differ by one row at most and add up to all rows, so shard
sizes do too, while rows move only from full shards to their neighbours on the ring.

The ring is cut into cells. Rows are counted per cell; which part of an arc overflows, and
where to, is settled on these counts, whose number is a parameter; and a row finds its
shard from its rank on its arc, which is the rows in earlier cells plus its rank in its
own. Nothing that grows with the data is sorted or gathered as a whole.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codestrata.llm import common

CELLS = 1024
NODES = 24
# Rows of one cell are ranked in so many groups.
SALTS = 8


def cell_count(shards: int, nodes: int) -> int:
    """Cells of a ring at most half full of virtual nodes."""
    return max(CELLS, 1 << (2 * shards * nodes - 1).bit_length())


def node_cells(shards: int, nodes: int = NODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """Cell and shard of each virtual node, in ring order; nodes never share a cell."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for node in range(nodes):
            cell = zlib.crc32(f"{shard}/{node}".encode()) % cells
            while cell in taken:
                cell = (cell + 1) % cells
            taken[cell] = shard
    return sorted(taken.items())


def settle(
    loads: list[int], owners: list[int], capacity: list[int]
) -> list[list[tuple[int, int, int]]]:
    """Parts ``(from rank, to rank, shard)`` of each arc, given loads and owners in order.

    In every round each arc offers what is left of it to the next node clockwise; a shard
    takes what fits, in ring order. Capacities must add up to the loads at least.
    """
    free, parts = list(capacity), [[] for _ in loads]
    placed = [0] * len(loads)
    for step in range(len(loads) + 1):
        for arc, load in enumerate(loads):
            shard = owners[(arc + step) % len(owners)]
            take = min(load - placed[arc], free[shard])
            if take:
                parts[arc].append((placed[arc], placed[arc] + take, shard))
                placed[arc] += take
                free[shard] -= take
        if placed == loads:
            break
    return parts


def capacities(total: int, shards: int) -> list[int]:
    """Equal shares of the rows; the first shards take one more where it doesn't divide."""
    return [total // shards + (shard < total % shards) for shard in range(shards)]


def position(id_column: Column, cells: int) -> Column:
    """Place on the ring: a cell, and a hash that orders the rows of a cell."""
    return F.struct(
        F.pmod(F.xxhash64(id_column), F.lit(cells)).cast("int").alias("cell"),
        F.xxhash64(id_column, F.lit(1)).alias("order"),
    )


def ring_plan(counts: dict[int, int], shards: int, nodes: int) -> list[dict]:
    """Pieces of cells: ``cell, low, high`` (ranks in the cell), ``shard, offset``.

    ``offset`` plus the rank in the cell is the slot of a row in its shard.
    """
    cells = cell_count(shards, nodes)
    ring = node_cells(shards, nodes, cells)
    places = [cell for cell, _ in ring]
    arcs: dict[int, list[int]] = defaultdict(list)
    arc = 0
    for cell in range(cells):
        while arc < len(places) and places[arc] < cell:
            arc += 1
        arcs[arc % len(places)].append(cell)
    loads = [sum(counts.get(c, 0) for c in arcs[a]) for a in range(len(places))]
    parts = settle(loads, [s for _, s in ring], capacities(sum(loads), shards))
    pieces, used = [], [0] * shards
    for a in range(len(places)):
        start = 0
        for cell in arcs[a]:
            size = counts.get(cell, 0)
            for low, high, shard in parts[a]:
                first, last = max(low, start), min(high, start + size)
                if first < last:
                    pieces.append({"cell": cell, "low": first - start, "high": last - start,
                                   "shard": shard, "offset": used[shard] - (first - start)})
                    used[shard] += last - first
            start += size
    return pieces


def shard_rows(
    docs: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    nodes: int = NODES,
) -> DataFrame:
    """Rows ``id, size, text_crc32, shard, slot``, one for every row of ``docs``.

    ``size`` is the text's bytes plus one, ``slot`` a gapless number from 0 in each shard.
    Null texts count as empty. Equal rows are interchangeable, so repeated ids are placed
    one by one; null ids share one place on the ring and overflow from there like any hot
    key. An empty table gives no rows. No other column is read.
    """
    spark: SparkSession = docs.sparkSession
    rows = common.texts(docs, id_col, text_col).select(
        "id",
        (F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32("text").alias("text_crc32"),
        position(F.col("id"), cell_count(shards, nodes)).alias("at"),
    )
    # Ties of the whole order are equal rows; the salt keeps a hot id in many groups.
    salt = F.pmod(F.xxhash64("size", "text_crc32"), F.lit(SALTS)).cast("int")
    rows = common.staged(rows.withColumn("salt", salt), "ring")
    # Cells and salts are parameters, so these counts are few whatever the rows.
    counted = {
        (row["cell"], row["salt"]): row["n"]
        for row in rows.groupBy(F.col("at.cell").alias("cell"), "salt")
        .agg(F.count("*").alias("n"))
        .collect()
    }
    per_cell: dict[int, int] = defaultdict(int)
    before: dict[tuple[int, int], int] = {}
    for (cell, part), n in sorted(counted.items()):
        before[cell, part] = per_cell[cell]
        per_cell[cell] += n
    return _placed(spark, rows, per_cell, before, counted, shards, nodes)


def _placed(spark, rows, per_cell, before, counted, shards, nodes) -> DataFrame:
    by_cell: dict[int, list[dict]] = defaultdict(list)
    for piece in ring_plan(per_cell, shards, nodes):
        by_cell[piece["cell"]].append(piece)
    pieces = []
    for (cell, part), first in before.items():
        last = first + counted[cell, part]
        for piece in by_cell[cell]:
            low, high = max(piece["low"], first), min(piece["high"], last)
            if low < high:
                pieces.append([cell, part, low - first, high - first, piece["shard"],
                               piece["offset"] + first])
    schema = "array<struct<cell int, salt int, low long, high long, shard int, offset long>>"
    names = ("cell", "salt", "low", "high", "shard", "offset")
    text = json.dumps([dict(zip(names, piece, strict=True)) for piece in pieces])
    plan = spark.range(1).select(F.inline(F.from_json(F.lit(text), schema)))
    within = Window.partitionBy("at.cell", "salt").orderBy(
        "at.order", "id", "size", "text_crc32"
    )
    ranked = rows.withColumn("rank", F.row_number().over(within) - 1)
    return (
        ranked.alias("r")
        .join(
            plan.alias("p"),
            (F.col("r.at.cell") == F.col("p.cell"))
            & (F.col("r.salt") == F.col("p.salt"))
            & (F.col("rank") >= F.col("low"))
            & (F.col("rank") < F.col("high")),
        )
        .select(
            common.real_id(F.col("id")).alias("id"), "size", "text_crc32", "shard",
            (F.col("offset") + F.col("rank")).cast("long").alias("slot"),
        )
    )
