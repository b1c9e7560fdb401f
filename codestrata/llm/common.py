"""What the text operators share: inputs, stage tables, shipping of task code, components."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.session import remove_at_exit, shared_folder

# The characters that separate words: space and \x09 to \x0D.
SPACES = " \t\n\x0b\f\r"
WORD_GAPS = "[ \\t-\\r]+"
# Stands for a null id, so that rows without one are treated as one, smallest id.
NO_ID = -(2**63)
# Edges that one task joins in memory.
BLOCK_EDGES = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Id and text as ``id`` and ``text``: null ids are ``NO_ID``, null texts empty."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *more,
    )


def own_id(column: Column) -> Column:
    """The id with null turned to ``NO_ID``."""
    return F.coalesce(column.cast("long"), F.lit(NO_ID))


def real_id(column: str | Column) -> Column:
    """The id with ``NO_ID`` turned back to null."""
    return F.nullif(F.col(column) if isinstance(column, str) else column, F.lit(NO_ID))


def words(text: Column) -> Column:
    """Words of a text in order; none for a blank one."""
    parts = F.split(F.btrim(text, F.lit(SPACES)), WORD_GAPS)
    return F.when(F.btrim(text, F.lit(SPACES)) == "", F.array().cast("array<string>")).otherwise(
        parts
    )


def lower_ascii(text: Column) -> Column:
    """A to Z lower-cased, everything else as it is; plain ASCII takes the built-in path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def fresh(taken: list[str], name: str) -> str:
    """A column name that is not among the taken ones."""
    used = {column.lower() for column in taken}
    while name.lower() in used:
        name += "_"
    return name


def ship(module: str) -> None:
    """Send a module's functions with the tasks, so executors need no installed package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)

def staged(frame: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, outlives executors.

    The folders are removed when the driver's process ends, as results may still read them.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/stage-{label}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(frame.schema).parquet(path)


def components(edges: DataFrame, rounds: int = 40, block: int = BLOCK_EDGES) -> DataFrame:
    """Smallest reachable node of every node of ``edges(a, b)``: rows ``node, root``.

    Every round first joins the edges within blocks of bounded size and then takes a
    large-star and a small-star step over all of them, so the number of rounds grows with
    the logarithm of the longest chain. Edges stay distributed, and a round's result is
    written before the next one reads it. What fits one block needs no further round.
    """
    edges = staged(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b")
        .distinct(),
        "edges",
    )
    state = _fingerprint(edges)
    for _ in range(rounds):
        blocks = -(-state[0] // block)
        joined = edges.coalesce(max(1, blocks)).mapInArrow(_join_blocks, "a long, b long")
        edges = staged(joined, "joined")
        if blocks <= 1:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        # Larger neighbours move to the smallest one, and the node itself keeps its link.
        large = edges.select(F.col("a").alias("y"), F.col("b").alias("n")).join(low, "n")
        large = large.select(F.col("y").alias("a"), F.col("m").alias("b")).unionByName(
            low.select(F.col("n").alias("a"), F.col("m").alias("b"))
        )
        large = staged(large.where("a <> b").distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        first = F.col("b") == F.col("m")
        small = large.join(least, "a").select(
            F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")
        )
        edges = staged(small.where("a <> b").distinct(), "small")
        now = _fingerprint(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle; raise the number of rounds")
    stars = edges.groupBy("a").agg(F.min("b").alias("m"))
    members = stars.select(F.col("a").alias("node"), F.col("m").alias("root"))
    roots = stars.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct()
    return members.unionByName(roots)


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars that connect what the edges of one block connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def stars() -> pa.RecordBatch:
        links = [(x, root(x)) for x in parent if root(x) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in links], pa.int64()),
             pa.array([b for _, b in links], pa.int64())],
            ["a", "b"],
        )

    for batch in batches:
        for a, b in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        if len(parent) > 4 * BLOCK_EDGES:
            yield stars()
    yield stars()


def _fingerprint(edges: DataFrame) -> tuple:
    """Count and order-free checksums of the edges."""
    first = F.xxhash64("a", "b").cast("decimal(38,0)")
    second = F.xxhash64("b", "a").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(first), F.sum(second)).first())
