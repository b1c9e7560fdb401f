"""Ranked and projected views of the indicator mart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.names import short_name

# The columns of each report table in order, and the charted metrics.
ACTIVITY = (
    "repository", "stars", "forks", "total_commits", "contributors", "avg_ccn",
    "testability", "activity_score",
)
CONCENTRATION = (
    "repository", "contributors", "top5_commit_share_pct", "concentration_risk",
)
MAINTAINABILITY = (
    "repository", "total_loc", "avg_ccn", "avg_method_nloc", "avg_method_params",
    "test_methods", "testability",
)
MODULARITY = ("repository", "classes", "interfaces", "methods", "inheritance_links")
PULL_REQUEST_HEALTH = (
    "repository", "pr_open", "pr_closed", "avg_commits_per_pr", "avg_pr_close_hours",
)
CHARTED = ("stars", "activity_score", "avg_ccn", "testability", "top5_commit_share_pct")


def present(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Those of the columns that exist, in the given order."""
    return rows.select(*(name for name in names if name in rows.columns))


def complete(rows: DataFrame, names: Sequence[str]) -> DataFrame | None:
    """All of the columns, or no table at all when one is missing."""
    if set(names) <= set(rows.columns):
        return rows.select(*names)
    return None


def activity_ranking(indicators: DataFrame) -> DataFrame:
    ranked = indicators.orderBy(F.desc("activity_score"), "repository")
    return present(ranked, ACTIVITY)


def concentration_ranking(indicators: DataFrame) -> DataFrame | None:
    if "concentration_risk" not in indicators.columns:
        return None
    ranked = indicators.orderBy(F.desc("top5_commit_share_pct"), "repository")
    return ranked.select(*CONCENTRATION)


def maintainability_view(indicators: DataFrame) -> DataFrame:
    return present(indicators, MAINTAINABILITY)


def modularity_view(indicators: DataFrame) -> DataFrame | None:
    return complete(indicators, MODULARITY)


def pull_request_view(indicators: DataFrame) -> DataFrame | None:
    return complete(indicators, PULL_REQUEST_HEALTH)


def metric_series(indicators: DataFrame, metrics: Sequence[str] = CHARTED) -> DataFrame:
    """Every charted metric as (metric, repository, short name, value), ascending.

    A global sort is range partitioned, so the long table stays distributed; numbering
    the rows of a metric would put all repositories into one task.
    """
    charted = [name for name in metrics if name in indicators.columns]
    values = indicators.select(
        "repository", *(F.col(name).cast("double").alias(name) for name in charted)
    )
    series = values.unpivot(["repository"], charted, "metric", "value")
    return series.select(
        "metric", "repository", short_name(F.col("repository")).alias("short_name"), "value"
    ).orderBy("metric", "value", "repository")


def scope_size(indicators: DataFrame) -> DataFrame:
    return indicators.agg(F.count(F.lit(1)).alias("repositories"))
