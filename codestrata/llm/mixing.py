"""Mixing sources to target weights by fitting a subset sum to each source's budget.

Documents are counted by source and exact length, and each may be taken several times. The
budget is spread over the lengths in proportion, and what rounding leaves is filled by a
bounded-knapsack dynamic program over the copies still available, to the nearest sum on either
side. Where that misses the budget, more of it is left to the program. Which documents of a
length are taken once more than the others is decided by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codestrata.llm import common

common.ship(__name__)

# The dynamic program runs over a rest of at most so many words.
DP_WORDS = 1 << 15
# Documents of one source and length are ranked in so many groups.
CELLS = 1024


def word_count(text: Column) -> Column:
    blank = F.btrim(text, F.lit(common.SPACES)) == ""
    parts = F.size(F.split(F.btrim(text, F.lit(common.SPACES)), common.WORD_GAPS))
    return F.when(blank, F.lit(0)).otherwise(parts).cast("long")


def source_key(source: Column) -> Column:
    """A source as a key that is never null; the key of null sorts last by its flag."""
    return F.struct(source.isNull().alias("missing"), F.coalesce(source, F.lit("")).alias("name"))


def ranked_sources(rows: DataFrame) -> DataFrame:
    """Rows ``key, words, place``: places from 0 by code point, null last.

    Sources are sorted by range, counted per range and ranked within it, so no task needs
    all of them.
    """
    sums = rows.groupBy("key").agg(F.sum("size").alias("words"))
    ranges = common.staged(
        sums.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "sources"
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranges.groupBy("part").agg(F.count("*").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    within = Window.partitionBy("part").orderBy("key")
    return ranges.join(offsets, "part").select(
        "key", "words", (F.col("offset") + F.row_number().over(within) - 1).alias("place")
    )


def targets(rows: DataFrame, weights: list[int], most: int) -> DataFrame:
    """Rows ``key, words, target``: shares of all words by weight, capped and reshared.

    Water filling: a source gets ``level * weight`` words unless that exceeds ``most``
    times its own. Each round is one distributed sum, and capped sources stay capped.
    """
    weight = F.array(*[F.lit(w) for w in weights])
    sources = common.staged(
        ranked_sources(rows).select(
            "key", "words", F.get(weight, F.col("place") % len(weights)).alias("weight")
        ),
        "weights",
    )
    cap = F.col("words") * most
    total = sources.agg(F.sum("words")).first()[0] or 0
    level = None
    while True:
        above = F.lit(False) if level is None else cap < F.col("weight") * level
        spent, share = sources.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
        ).first()
        now = (total - spent) / share if share else level or 0.0
        if level is not None and now <= level:
            break
        level = now
    wanted = F.least(F.col("weight") * F.lit(float(level)), cap.cast("double"))
    return sources.select("key", "words", wanted.alias("target"))


def fill(
    lengths: np.ndarray, counts: np.ndarray, budget: int, limit: int, most: int = 1
) -> np.ndarray:
    """How many copies of each length to take, so that their words come to ``budget``.

    A length has ``most`` copies of each of its documents. The total is the budget wherever
    the program finds choices that reach it, else the nearest sum found. ``lengths`` are
    positive, distinct and ascending.
    """
    words = int((lengths * counts).sum())
    copies = most * counts
    if budget >= most * words:
        return copies
    best, missed = np.zeros_like(counts), budget
    # Small sources are left to the program whole in the end.
    for slack in (0, limit // 16, limit // 4, limit):
        full, part = divmod(max(0, budget - slack), words)
        spread = full * counts + (counts.astype(object) * part // words).astype(np.int64)
        best, missed = _better(lengths, copies, spread, budget, limit, best, missed)
        if not missed:
            return best
    # Few and long texts may fit only if they come before the spread.
    packed, rest = np.zeros_like(counts), budget
    for i in np.flatnonzero(lengths > limit)[::-1]:
        packed[i] = min(int(copies[i]), rest // int(lengths[i]))
        rest -= int(packed[i] * lengths[i])
    return _better(lengths, copies, packed, budget, limit, best, missed)[0]


def _better(
    lengths: np.ndarray, copies: np.ndarray, start: np.ndarray, budget: int, limit: int,
    best: np.ndarray, missed: int,
) -> tuple[np.ndarray, int]:
    """The better of the best choice so far and the one that begins with ``start``."""
    taken = _filled(lengths, copies, start, budget, limit)
    off = abs(budget - int((lengths * taken).sum()))
    return (taken, off) if off < missed else (best, missed)


def _filled(
    lengths: np.ndarray, counts: np.ndarray, taken: np.ndarray, budget: int, limit: int
) -> np.ndarray:
    """Adds to what is taken: longest first while the rest is over the limit, then exactly."""
    taken, longest = taken.copy(), np.argsort(-lengths, kind="stable")
    rest = budget - int((lengths * taken).sum())
    for i in longest:
        # One of each, until the dynamic program can hold the rest.
        if rest > limit and lengths[i] <= rest - limit // 2 and taken[i] < counts[i]:
            taken[i] += 1
            rest -= int(lengths[i])
    for i in longest:
        if rest > limit:
            more = min(int(counts[i] - taken[i]), max(0, rest - limit // 2) // int(lengths[i]))
            if not more and lengths[i] <= rest and taken[i] < counts[i]:
                more = 1
            taken[i] += more
            rest -= more * int(lengths[i])
    budget_left = min(rest, limit)
    return taken + nearest(lengths, counts - taken, budget_left)


def nearest(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Multiplicities whose sum is nearest to the budget, on either side of it."""
    below = knapsack(lengths, counts, budget, budget)
    gap = budget - int((lengths * below).sum())
    if gap <= 1:
        return below
    above = knapsack(lengths, counts, budget, budget + gap - 1)
    return above if abs(budget - int((lengths * above).sum())) < gap else below


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int, top: int) -> np.ndarray:
    """Multiplicities within ``counts`` whose sum, up to ``top``, is nearest to ``budget``.

    Reachable sums are the bits of an integer. Multiplicities are split into powers of two,
    and the sums before each step are kept to trace the choice back.
    """
    mask, reach = (1 << (top + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for i, length in enumerate(lengths.tolist()):
        left, part = min(int(counts[i]), top // length), 1
        while left > 0 and not reach >> budget & 1:
            part = min(part, left)
            grown = reach | reach << part * length & mask
            if grown != reach:
                steps.append((i, part, reach))
            reach = grown
            left, part = left - part, part * 2
        if length > top or reach >> budget & 1:
            break
    lower = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
    higher = reach >> (budget + 1)
    upper = budget + (higher & -higher).bit_length() if higher else None
    at = lower if upper is None or budget - lower <= upper - budget else upper
    chosen = np.zeros_like(counts)
    for i, part, before in reversed(steps):
        if not before >> at & 1:
            chosen[i] += part
            at -= part * int(lengths[i])
    return chosen


def plan(frames: Iterable[pd.DataFrame], most: int, limit: int) -> pd.DataFrame:
    """Copies of every document of a length, and how many of them are taken once more."""
    (frame,) = frames
    frame = frame.sort_values("size", ignore_index=True)
    used = (frame["size"] > 0).to_numpy()
    numbers = frame["n"].to_numpy()
    copies = np.zeros(len(frame), np.int64)
    copies[used] = fill(
        frame["size"].to_numpy()[used], numbers[used], round(float(frame["target"][0])), limit, most
    )
    return pd.DataFrame(
        {"missing": frame["missing"], "name": frame["name"], "size": frame["size"],
         "words": frame["words"], "target": frame["target"], "full": copies // numbers,
         "picks": copies % numbers}
    )


def mix(
    docs: DataFrame,
    weights: list[int],
    most: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 17,
    limit: int = DP_WORDS,
) -> DataFrame:
    """Rows ``id, source, text_hash, size, source_size, target, taken`` for all ``docs``.

    Sources in code-point order, null last, get the weights in turn. ``taken`` is the
    document's words times the copies the mix holds, at most ``most`` copies. Null, empty
    and blank texts have no words and are not taken; repeated rows are documents of their
    own, and equal ones are interchangeable; an empty table gives no rows.
    """
    rows = common.texts(docs, id_col, text_col, F.col(source_col).alias("source")).select(
        "id", "source", source_key(F.col("source")).alias("key"),
        word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"),
    )
    rows = common.staged(rows, "sizes")
    lengths = rows.groupBy("key", "size").agg(F.count("*").alias("n"))
    lengths = lengths.join(targets(rows, weights, most), "key").select(
        "key.missing", "key.name", "size", "n", "words", "target"
    )

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        return plan([frame], most, limit)

    # A source's lengths are at most as many as its longest text has words.
    plans = lengths.groupBy("missing", "name").applyInPandas(
        fit, "missing boolean, name string, size long, words long, target double, "
        "full long, picks long"
    )
    order = F.xxhash64("id", "text_hash", F.lit(seed))
    ranked = rows.where("size > 0").withColumn("order", order).withColumn(
        "cell", F.pmod("order", F.lit(CELLS)).cast("int")
    )
    before = Window.partitionBy("key", "size").orderBy("cell").rowsBetween(
        Window.unboundedPreceding, -1
    )
    cells = ranked.groupBy("key", "size", "cell").agg(F.count("*").alias("n")).select(
        "key", "size", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")
    )
    plans = plans.select(
        F.struct("missing", "name").alias("key"), "size", "words", "target", "full", "picks"
    )
    within = Window.partitionBy("key", "size", "cell").orderBy("order", "id", "text_hash")
    rank = F.col("earlier") + F.row_number().over(within)
    picked = (
        ranked.join(cells.join(plans, ["key", "size"]), ["key", "size", "cell"])
        .withColumn("copies", F.col("full") + (rank <= F.col("picks")).cast("long"))
    )
    # Nothing of a text without words can be taken, so these need no rank.
    idle = rows.where("size = 0").join(plans, ["key", "size"])
    columns = ["id", "source", "text_hash", "size", F.col("words").alias("source_size"), "target"]
    return picked.select(*columns, (F.col("size") * F.col("copies")).alias("taken")).unionByName(
        idle.select(*columns, F.lit(0).cast("long").alias("taken"))
    ).withColumn("id", common.real_id("id"))
