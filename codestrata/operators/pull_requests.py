"""Pull-request facts and their health per repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.instants import elapsed_hours, iso_instant
from codestrata.functions.names import non_empty, text_or_blank
from codestrata.functions.numeric import coerce_number, decimal_mean, round_exact, round_scaled
from codestrata.operators.ranking import top_per_key
from codestrata.schemas import columns


def derived_state() -> Column:
    return F.when(non_empty(F.col("merged_at")).isNotNull(), "merged").otherwise(F.col("state"))


def hours_to_close() -> Column:
    """Hours from creation to closing or else merging; NULL when either is missing."""
    ended = F.coalesce(non_empty(F.col("closed_at")), non_empty(F.col("merged_at")))
    return round_exact(elapsed_hours(iso_instant(F.col("created_at")), iso_instant(ended)), 2)


def pull_request_facts(
    raw: DataFrame, newest: int | None = None, counted: int | None = None
) -> DataFrame:
    """Pull requests with their state and hours; all of them unless limits are given.

    ``newest`` keeps so many per repository and ``counted`` keeps the commit counts of so
    many. Both change every mean taken afterwards, so no analysis sets them.
    """
    commits = F.col("commits")
    kept = raw
    if newest is not None or counted is not None:
        order = [F.desc_nulls_last("created"), F.desc("number")]
        dated = raw.withColumn("created", iso_instant(F.col("created_at")))
        if newest is not None:
            kept = top_per_key(dated, ["repository"], order, newest, ["number"])
        else:
            place = F.row_number().over(Window.partitionBy("repository").orderBy(*order))
            kept = dated.withColumn("rank", place)
        if counted is not None:
            commits = F.when(F.col("rank") <= counted, commits)
    derived = {
        "state": derived_state(),
        "closed_at": text_or_blank(F.col("closed_at")),
        "merged_at": text_or_blank(F.col("merged_at")),
        "hours_to_close": hours_to_close(),
        "commits": commits,
    }
    return kept.select(
        *(derived.get(name, F.col(name)).alias(name) for name in columns("pull_requests"))
    )


def pull_request_health(pull_requests: DataFrame) -> DataFrame:
    """Open and closed counts and means; a mean without any number is NULL."""

    def mean(name: str) -> Column:
        return round_scaled(decimal_mean(coerce_number(F.col(name))), 2)

    return pull_requests.groupBy("repository").agg(
        F.count_if(F.col("state") == "open").alias("pr_open"),
        F.count_if(F.col("state").isin("closed", "merged")).alias("pr_closed"),
        mean("commits").alias("avg_commits_per_pr"),
        mean("hours_to_close").alias("avg_pr_close_hours"),
    )
