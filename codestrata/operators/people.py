"""How commits are distributed over the authors of a repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.numeric import round_scaled

# Size of the leading group and the risk thresholds in percent.
LEADERS = 5
HIGH_RISK = 80
MEDIUM_RISK = 60


def contribution_share(
    developers: DataFrame, n: int = LEADERS, name: str = "top5_commit_share_pct"
) -> DataFrame:
    """Contributors per repository and the share of commits made by the top ``n``.

    Authors are first counted per commit count. A repository with ``c`` commits has at
    most ``sqrt(2c)`` different counts, so the ranking window stays small even for a
    repository with most of the authors; the top ``n`` is then taken from the counts,
    cutting the last one that does not fit.
    """
    same_count = developers.groupBy("repository", "commits").agg(
        F.count(F.lit(1)).alias("authors")
    )
    descending = (
        Window.partitionBy("repository")
        .orderBy(F.desc("commits"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ahead = F.sum("authors").over(descending) - F.col("authors")
    leading = F.least(F.col("authors"), F.greatest(F.lit(n) - ahead, F.lit(0)))
    totals = (
        same_count.withColumn("leading", leading)
        .groupBy("repository")
        .agg(
            F.sum("authors").alias("contributors"),
            F.sum(F.col("commits") * F.col("leading")).alias("led"),
            F.sum(F.col("commits") * F.col("authors")).alias("commits"),
        )
    )
    share = round_scaled(F.lit(100) * F.col("led") / F.nullif("commits", F.lit(0)), 2)
    return totals.select(
        "repository", "contributors", F.coalesce(share, F.lit(0.0)).alias(name)
    )


def concentration_risk(
    share: Column, high: float = HIGH_RISK, medium: float = MEDIUM_RISK
) -> Column:
    return F.when(share >= high, "high").when(share >= medium, "medium").otherwise("low")
