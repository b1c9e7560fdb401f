"""Commit, author and file summaries from the base facts.

The three summaries see different commits: the commit summary counts everything
reachable from the head, authors count non-merges of all branches, and files count
non-merges of the head (the change log is landed that way).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.instants import elapsed_days, iso_instant, local_day
from codestrata.functions.names import text_or_blank
from codestrata.operators.ranking import top_per_key
from codestrata.schemas import columns


def is_merge() -> Column:
    return F.col("parent_count") >= 2


def is_root() -> Column:
    return F.col("parent_count") == 0


def commit_summary(commits: DataFrame) -> DataFrame:
    """One ``commits`` row per repository.

    Counting goes by (repository, day) first, so a repository with most of the
    commits is reduced by many tasks before its days meet in one. The two commits
    whose text is kept come from a second, filtered read of the few root and head
    rows: keeping strings in the counting buffers would force a sort of all commits.
    """
    per_day = commits.groupBy("repository", local_day(F.col("committed_at_iso")).alias("day")).agg(
        F.count_if("on_head").alias("commits")
    )
    tallies = per_day.groupBy("repository").agg(
        F.sum("commits").alias("total_commits"),
        F.count_if((F.col("commits") > 0) & F.col("day").isNotNull())
        .cast("int")
        .alias("distinct_active_days"),
    )
    spans = first_and_last_commit(commits)
    started = iso_instant(F.col("first_commit"))
    ended = iso_instant(F.col("last_commit"))
    return tallies.join(spans, "repository", "left").select(
        "repository",
        "total_commits",
        text_or_blank(F.col("first_commit")).alias("first_commit"),
        text_or_blank(F.col("last_commit")).alias("last_commit"),
        F.coalesce(elapsed_days(started, ended), F.lit(0)).alias("span_days"),
        "distinct_active_days",
    )


def first_and_last_commit(commits: DataFrame) -> DataFrame:
    """Text of the oldest root commit of the head and of the head commit itself."""
    iso = F.col("committed_at_iso")
    root = F.col("on_head") & is_root()
    # A root whose date cannot be read is not the oldest one.
    readable = root & iso_instant(iso).isNotNull()
    dated = F.struct(iso_instant(iso).alias("instant"), iso.alias("iso"))
    return (
        commits.filter(root | F.col("is_head"))
        .groupBy("repository")
        .agg(
            F.min(F.when(readable, dated))["iso"].alias("first_commit"),
            F.max(F.when(F.col("is_head"), iso)).alias("last_commit"),
        )
    )


def developer_commits(commits: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Non-merge commits of all branches per author identity.

    With an author ``mapping``, identities are counted as written first, and the few that are
    left are mapped and added up.
    """
    counted = (
        commits.filter(~is_merge())
        .groupBy(
            "repository",
            F.col("author_name").alias("developer"),
            F.col("author_email").alias("email"),
        )
        .agg(F.count(F.lit(1)).alias("commits"))
    )
    if mapping is None:
        return counted
    return (
        mapped_authors(counted, mapping, "developer", "email")
        .groupBy("repository", "developer", "email")
        .agg(F.sum("commits").alias("commits"))
    )


def mapped_authors(rows: DataFrame, mapping: DataFrame, name: str, email: str) -> DataFrame:
    """Rows with their author's proper name and address, by a repository's author mapping.

    Names and addresses are compared without regard to case. A line with both name and address
    goes before one with the address alone; of lines for the same author the last one that
    states a name, or an address, counts. What no line states stays as it is.
    """
    stated = {
        part: F.max(F.when(F.col(part).isNotNull(), F.struct("place", part)))[part].alias(part)
        for part in ("proper_name", "proper_email")
    }
    key = {"by_name": F.lower("commit_name"), "by_email": F.lower("commit_email")}
    lines = mapping.select(
        F.col("repository").alias("mapped_repository"), "place", "proper_name", "proper_email",
        *(column.alias(alias) for alias, column in key.items()),
    ).groupBy("mapped_repository", "by_name", "by_email").agg(*stated.values())
    same_email = (F.col("repository") == F.col("mapped_repository")) & (
        F.lower(email) == F.col("by_email"))
    names = [F.struct("proper_name", "proper_email").alias("line")]
    exact = lines.filter(F.col("by_name").isNotNull()).select(
        "mapped_repository", "by_name", "by_email", *names)
    general = lines.filter(F.col("by_name").isNull()).select(
        "mapped_repository", "by_email", *names)
    first = rows.join(exact, same_email & (F.lower(name) == F.col("by_name")), "left").select(
        *rows.columns, F.col("line").alias("exact_line"))
    both = first.join(general, same_email, "left").withColumn(
        "line", F.coalesce("exact_line", "line"))
    new = {name: "proper_name", email: "proper_email"}
    return both.select(*(
        F.coalesce(f"line.{new[c]}", c).alias(c) if c in new else F.col(c) for c in rows.columns
    ))


def file_churn(changes: DataFrame) -> DataFrame:
    """Changes and line churn per file; ``first_seen`` is its place in the log."""
    return changes.groupBy("repository", "file").agg(
        F.count(F.lit(1)).alias("commits"),
        F.coalesce(F.sum("added"), F.lit(0)).alias("lines_added"),
        F.coalesce(F.sum("removed"), F.lit(0)).alias("lines_removed"),
        F.min("log_seq").alias("first_seen"),
    )


def changed_files(churn: DataFrame) -> DataFrame:
    """Every file with its churn, as ``files`` rows."""
    return churn.select(*columns("files"))


def most_changed_files(churn: DataFrame, n: int) -> DataFrame:
    """The ``n`` most changed files per repository, ties by first appearance.

    A report, not a step before other analyses: a complex but rarely changed file beyond
    the limit would be lost to them.
    """
    order = [F.desc("commits"), F.asc("first_seen"), F.asc("file")]
    return top_per_key(churn, ["repository"], order, n, ["file"]).select(*columns("files"))
