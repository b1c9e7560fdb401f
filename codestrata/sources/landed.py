"""Landed tables: CSV or Parquet with an explicit schema, empty when absent."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.names import strip
from codestrata.schemas import SCHEMAS, columns

# Free text with quoted line breaks only occurs here. Such files cannot be split,
# so every other table keeps one record per line.
MULTILINE_TABLES = frozenset({"repositories"})


def position_in_source() -> Column:
    """Long that increases with the position of a row in a file of text lines.

    A split holds fewer rows than bytes, so its byte offset plus the running row
    number of the task stays below the offset of the next split.
    """
    row_in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.col("_metadata.file_block_start") + row_in_task


def empty_table(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def scan_csv(
    spark: SparkSession, path: str, table: str, sequence: str | None = None
) -> DataFrame:
    """Read one table, failing on a wrong header or an unreadable value.

    ``sequence`` names an extra column holding the row's position in its file, for
    operators that keep the first row of a key.
    """
    reader = (
        spark.read.schema(SCHEMAS[table])
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", table in MULTILINE_TABLES)
        .option("enforceSchema", False)
        .option("nullValue", "")
        .option("mode", "FAILFAST")
    )
    return _scan(lambda: reader.csv(path), spark, table, sequence)


def scan_parquet(
    spark: SparkSession, path: str, table: str, sequence: str | None = None
) -> DataFrame:
    """Read one table; ``sequence`` names an extra column that orders rows as they lie.

    It holds the file and the row's number in it: encoded rows may take less than a byte,
    so byte offsets do not tell their order.
    """
    reader = spark.read.schema(SCHEMAS[table])
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    )
    return _scan(lambda: reader.parquet(path), spark, table, sequence, place)


def _scan(
    read, spark: SparkSession, table: str, sequence: str | None, place: Column | None = None
) -> DataFrame:
    try:
        rows = read()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = empty_table(spark, table)
        return rows if sequence is None else rows.withColumn(sequence, F.lit(0).cast("long"))
    if sequence is None:
        return rows
    place = position_in_source() if place is None else place
    return rows.select(*columns(table), place.alias(sequence))


def scan_repository_list(spark: SparkSession, path: str) -> DataFrame:
    """One repository per line, in file order (column ``seq``)."""
    lines = spark.read.text(path).select("value", position_in_source().alias("seq"))
    return parse_repository_list(lines)


def parse_repository_list(lines: DataFrame) -> DataFrame:
    """Drop blank lines and lines that start with ``#``; an indented ``#`` is kept."""
    return (
        lines.filter(~F.startswith("value", F.lit("#")))
        .select(strip(F.col("value")).alias("repository"), "seq")
        .filter(F.col("repository") != "")
    )
