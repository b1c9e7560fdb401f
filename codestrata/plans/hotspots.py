"""Files that change often and are complex."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.operators.code import file_complexity
from codestrata.schemas import columns

# Rows published, and rows shown in the report.
PUBLISHED_ROWS = 500
REPORTED_ROWS = 20


def hotspot_scores(files: DataFrame, methods: DataFrame) -> DataFrame:
    """Score of every kept file; a file without methods scores 0.

    Keys are joined as they are. Methods are reduced to one row per file before the
    join, so a file with many methods meets its counterpart once.
    """
    complexity = file_complexity(methods)
    average = F.coalesce("avg_ccn", F.lit(0.0))
    return files.join(complexity, ["repository", "file"], "left").select(
        "repository",
        "file",
        "commits",
        average.alias("avg_ccn"),
        (F.col("commits") * average).alias("hotspot_score"),
    )


def top_hotspots(scores: DataFrame, n: int = PUBLISHED_ROWS) -> DataFrame:
    """The ``n`` highest scores over all repositories, ties by key."""
    return (
        scores.orderBy(F.desc("hotspot_score"), "repository", "file")
        .limit(n)
        .select(*columns("hotspots"))
    )


def reported_hotspots(hotspots: DataFrame, n: int = REPORTED_ROWS) -> DataFrame:
    return top_hotspots(hotspots, n)
