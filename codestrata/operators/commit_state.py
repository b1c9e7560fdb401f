"""Commit, author and file summaries that grow with each fetch.

A state holds partial results of a log. States of disjoint parts of a log merge to the state of
the whole: counts add up, the first of the roots and the head of the latest fetch stay, and
active days are bitmaps that are joined with OR. So a fetch reads its new commits and the state,
never the old commits, and the summaries come out as from the whole log.

A bitmap holds 32,768 days of a repository in 4 kB, and tasks build and join bitmaps before any
shuffle, so a repository with most of the commits is a few rows per task.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.instants import elapsed_days, iso_instant, local_day
from codestrata.functions.names import text_or_blank
from codestrata.operators import history
from codestrata.operators.history import is_root

# Days from the first one of the calendar to 1970, so that day numbers are positive.
EPOCH_DAYS = 719_163


@dataclass(frozen=True)
class State:
    """Partial results by repository: active days, first and last commit, authors, files."""

    days: DataFrame
    ends: DataFrame
    developers: DataFrame
    files: DataFrame


def state_of(commits: DataFrame, changes: DataFrame, generation: int) -> State:
    """The state of the commits and file changes of one fetch.

    ``generation`` numbers the fetches; the head commit of the latest one counts.
    """
    iso = F.col("committed_at_iso")
    instant = iso_instant(iso)
    root = F.col("on_head") & is_root() & instant.isNotNull()
    ends = (
        commits.filter(root | F.col("is_head"))
        .groupBy("repository")
        .agg(
            F.min(F.when(root, F.struct(instant.alias("instant"), iso.alias("iso")))).alias("first"),
            F.max(F.when(F.col("is_head"), F.struct(F.lit(generation).alias("generation"),
                                                    iso.alias("iso")))).alias("last"),
        )
    )
    return State(
        active_days(commits), ends, history.developer_commits(commits), history.file_churn(changes)
    )


def active_days(commits: DataFrame) -> DataFrame:
    """Rows ``repository, bucket, odd_day, days, commits`` of the head's commits.

    Days are bits of ``days``. A day that is no date, as written, is kept as ``odd_day``.
    """
    day = local_day(F.col("committed_at_iso"))
    date = day.try_cast("date")
    proper = date.cast("string") == day
    number = F.when(proper, F.unix_date(date) + EPOCH_DAYS).cast("long")
    head = F.col("on_head")
    return commits.groupBy(
        "repository",
        F.when(head, F.bitmap_bucket_number(number)).alias("bucket"),
        F.when(head & ~F.coalesce(proper, F.lit(False)), day).alias("odd_day"),
    ).agg(
        F.bitmap_construct_agg(F.when(head, F.bitmap_bit_position(number))).alias("days"),
        F.count_if(head).alias("commits"),
    )


def _days_merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("repository", "bucket", "odd_day").agg(
        F.bitmap_or_agg("days").alias("days"), F.sum("commits").alias("commits")
    )


def _ends_merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("repository").agg(F.min("first").alias("first"), F.max("last").alias("last"))


def _developers_merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("repository", "developer", "email").agg(F.sum("commits").alias("commits"))


def _files_merged(rows: DataFrame) -> DataFrame:
    sums = ("commits", "lines_added", "lines_removed")
    return rows.groupBy("repository", "file").agg(
        *(F.sum(name).alias(name) for name in sums), F.min("first_seen").alias("first_seen")
    )


_MERGERS = {
    "days": _days_merged, "ends": _ends_merged, "developers": _developers_merged,
    "files": _files_merged,
}


def merged(*states: State) -> State:
    """The state of several fetches together, in any order."""
    return State(**{
        name: merge(reduce(DataFrame.unionByName, (getattr(state, name) for state in states)))
        for name, merge in _MERGERS.items()
    })


def commit_summary(state: State) -> DataFrame:
    """``commits`` rows, as ``history.commit_summary`` gives them for the whole log."""
    active = F.when(F.col("odd_day").isNotNull(), 1).otherwise(F.bitmap_count("days"))
    tallies = state.days.groupBy("repository").agg(
        F.sum("commits").alias("total_commits"),
        F.sum(F.when(F.col("commits") > 0, active).otherwise(0)).cast("int").alias(
            "distinct_active_days"),
    )

    def iso(end: str) -> Column:
        return F.col(f"{end}.iso")

    span = elapsed_days(F.col("first.instant"), iso_instant(iso("last")))
    return tallies.join(state.ends, "repository", "left").select(
        "repository", "total_commits",
        text_or_blank(iso("first")).alias("first_commit"),
        text_or_blank(iso("last")).alias("last_commit"),
        F.coalesce(span, F.lit(0)).alias("span_days"),
        "distinct_active_days",
    )


def write_state(state: State, path: str) -> None:
    """Lands a state in a new folder; the one it was merged from is still there to be read."""
    for field in fields(State):
        getattr(state, field.name).write.parquet(f"{path}/{field.name}")


def scan_state(spark: SparkSession, path: str) -> State:
    return State(**{f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(State)})
