"""Top rows per key that stay spread out when one key holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Upper bound on the tasks that share the first ranking of one key.
SPREAD = 64


def top_per_key(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    identity: Sequence[str] = (),
    rank: str = "rank",
) -> DataFrame:
    """The first ``n`` rows of each key under ``order``, with their rank.

    Spark pushes the limit below the shuffle, so a key sends at most ``n`` rows per
    task to its ranking. That is few for a small ``n``. For a larger one pass
    ``identity``, columns that vary within a key: rows are then ranked in buckets by
    their hash first, and the last ranking sees at most ``SPREAD * n`` rows of a key,
    however many tasks there are. A row of the true top ``n`` is in the top ``n`` of its
    bucket, so the result is exact either way.
    """
    if identity:
        bucket = F.pmod(F.xxhash64(*identity), F.lit(SPREAD))
        within_bucket = Window.partitionBy(*keys, "_bucket").orderBy(*order)
        rows = (
            rows.withColumn("_bucket", bucket)
            .withColumn("_rank", F.row_number().over(within_bucket))
            .filter(F.col("_rank") <= n)
            .drop("_bucket", "_rank")
        )
    within_key = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(within_key)).filter(F.col(rank) <= n)


def first_per_key(rows: DataFrame, key: str, sequence: str = "ingest_seq") -> DataFrame:
    """The first row of each key in landing order.

    Without a sequence column the order is that of the remaining columns, so that
    the choice does not depend on partitioning.
    """
    others = [name for name in rows.columns if name not in (key, sequence)]
    order = [sequence, *others] if sequence in rows.columns else others
    first = top_per_key(rows, [key], [F.col(name) for name in order], 1)
    return first.drop("rank", sequence)
