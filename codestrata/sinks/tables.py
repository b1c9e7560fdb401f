"""Idempotent table writers: every write replaces what was there."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.names import strip
from codestrata.schemas import PUBLISHED, SCHEMAS, columns
from codestrata.sources.landed import empty_table


def write_csv(rows: DataFrame, path: str, table: str) -> None:
    """Fixed header, blank for NULL and for the empty string."""
    (
        rows.select(*columns(table))
        .write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(path)
    )


def write_parquet(rows: DataFrame, path: str, table: str) -> None:
    """The default format: keeps the schema, also of a table without rows."""
    rows.select(*columns(table)).write.mode("overwrite").parquet(path)


def replace_repositories(rows: DataFrame, path: str, table: str) -> None:
    """Lands the rows of some repositories and leaves those of all others as they are.

    The table is partitioned by its key, and only partitions with new rows are overwritten,
    which Spark does in one step when all tasks have ended. Rows of one repository are spread
    over several files if they are many. A repository without new rows keeps its old ones, and
    a blank key is no key.
    """
    (
        rows.select(*columns(table))
        .hint("rebalance", "repository")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("repository")
        .parquet(path)
    )


def scan_replaced(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table landed by ``replace_repositories``, with its columns in their order."""
    return spark.read.schema(SCHEMAS[table]).parquet(path).select(*columns(table))


def write_nothing(spark: SparkSession, path: str, table: str) -> None:
    """Landing of a collector that had no data: a header and no rows."""
    write_csv(empty_table(spark, table).coalesce(1), path, table)


def write_repository_list(selected: DataFrame, path: str) -> None:
    """One name per line in selection order, in one file.

    ``selected`` is the output of a top-n selection, so one task is enough.
    """
    selected.select("full_name").coalesce(1).write.mode("overwrite").text(path)


def consolidate(
    spark: SparkSession, tables: Mapping[str, DataFrame], database: str | None = None
) -> list[str]:
    """Publish the given tables in the catalog and return their names.

    Tables without a DataFrame are left out. The ``repository`` key is stripped here
    and nowhere else.
    """
    published = []
    for table in PUBLISHED:
        if table not in tables:
            continue
        rows = normalise_key(tables[table])
        name = f"{database}.{table}" if database else table
        rows.write.mode("overwrite").saveAsTable(name)
        published.append(name)
    return published


def normalise_key(rows: DataFrame) -> DataFrame:
    if "repository" not in rows.columns:
        return rows
    return rows.withColumn("repository", strip(F.col("repository").cast("string")))
