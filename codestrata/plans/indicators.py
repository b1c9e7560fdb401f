"""One row of quality indicators per repository."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.numeric import ratio_or_zero
from codestrata.operators.code import complexity_summary, structure_summary
from codestrata.operators.people import concentration_risk, contribution_share
from codestrata.operators.pull_requests import pull_request_health
from codestrata.operators.ranking import first_per_key
from codestrata.schemas import columns

# Fixed value: weight of an active day in the activity score.
ACTIVE_DAY_WEIGHT = 5

# Tables whose keys make a repository known. Files, pull requests and methods do not.
KEY_TABLES = ("repositories", "commits", "developers", "loc", "tests", "profile", "structure")

# Column that marks a table as landed row by row, with its place in the file.
SEQUENCE = "ingest_seq"

PULL_REQUEST_MEANS = ("avg_commits_per_pr", "avg_pr_close_hours")


def align_key(repositories: DataFrame) -> DataFrame:
    """The metadata table names its key differently."""
    if "full_name" not in repositories.columns:
        return repositories
    return repositories.withColumnRenamed("full_name", "repository")


def stack(*tables: DataFrame) -> DataFrame:
    """Rows of all tables; columns a table lacks are NULL."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), tables)


def known_repositories(*tables: DataFrame) -> DataFrame:
    """Distinct keys of the given tables."""
    keys = (align_key(table).select(F.col("repository").cast("string")) for table in tables)
    return stack(*keys).filter(F.col("repository").isNotNull()).distinct()


def activity_score(weight: int = ACTIVE_DAY_WEIGHT) -> Column:
    return (
        F.col("total_commits")
        + F.col("active_days") * weight
        + F.col("pr_open")
        + F.col("pr_closed")
    )


def _measures(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every table reduced to at most one row per repository.

    Tables that are looked up by key keep their first row per key, by the sequence column
    where they carry one. A ``profile`` stands for ``loc`` and ``tests`` at once, so the
    source texts behind it are read once.
    """

    def first(table: str, *names: str) -> DataFrame:
        rows = tables[table]
        order = [SEQUENCE] if SEQUENCE in rows.columns else []
        return first_per_key(rows.select("repository", *names, *order), "repository")

    if "profile" in tables:
        sources = {
            "profile": first("profile", "code", "test_methods").withColumnRenamed(
                "code", "total_loc"
            )
        }
    else:
        sources = {
            "loc": first("loc", "code").withColumnRenamed("code", "total_loc"),
            "tests": first("tests", "test_methods"),
        }

    health = pull_request_health(tables["pull_requests"])
    return {
        "repositories": first("repositories", "stars", "forks"),
        "commits": first("commits", "total_commits", "distinct_active_days").withColumnRenamed(
            "distinct_active_days", "active_days"
        ),
        "developers": contribution_share(tables["developers"]),
        **sources,
        "structure": structure_summary(tables["structure"]),
        "complexity": complexity_summary(tables["complexity"]),
        "pull_requests": health.withColumn("has_pull_requests", F.lit(1)),
    }


def quality_indicators(tables: dict[str, DataFrame]) -> DataFrame:
    """The indicator mart from the eight tables named in ``_measures``.

    Each measure has at most one row per repository, so a left join of the known keys
    to all of them equals stacking them and collapsing each key: every column has at
    most one value to keep. That takes one shuffle of reduced rows where eight joins
    would take eight sorts, and it yields the union of the keys on the way.
    """
    tables = dict(tables, repositories=align_key(tables["repositories"]))
    measures = _measures(tables)
    rows = stack(
        *(
            measure.withColumn("known", F.lit(table in KEY_TABLES))
            for table, measure in measures.items()
        )
    )
    values = [name for name in rows.columns if name not in ("repository", "known")]
    collapsed = (
        rows.filter(F.col("repository").isNotNull())
        .groupBy("repository")
        .agg(F.bool_or("known").alias("known"), *(F.max(name).alias(name) for name in values))
        .filter("known")
    )
    return derive_indicators(collapsed)


def derive_indicators(collapsed: DataFrame) -> DataFrame:
    """Defaults for missing measures and the columns computed from others.

    A mean over pull requests that exist but hold no number stays NULL; it is 0.0 only
    where the repository has no pull request at all.
    """
    counted = [name for name in collapsed.columns if name not in PULL_REQUEST_MEANS]

    def mean(name: str) -> Column:
        return F.when(F.col("has_pull_requests") == 1, F.col(name)).otherwise(F.lit(0.0))

    return collapsed.fillna(0, subset=counted).withColumns(
        {name: mean(name) for name in PULL_REQUEST_MEANS}
        | {
            "concentration_risk": concentration_risk(F.col("top5_commit_share_pct")),
            "testability": ratio_or_zero(F.col("test_methods"), F.col("methods"), 4),
            "activity_score": activity_score(),
        }
    ).select(*columns("quality_indicators"))


def in_key_order(rows: DataFrame) -> DataFrame:
    """Published order: by code point, so capitals come first."""
    return rows.orderBy("repository")
