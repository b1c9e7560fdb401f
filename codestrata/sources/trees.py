"""Checked-out source trees and the line counts of an external counter."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.names import repository_of
from codestrata.schemas import struct

REPLACEMENT = "\ufffd"

_COUNTS = struct("nFiles long, blank long, comment long, code long")
LINE_COUNT_JSON = struct("unreadable string", Java=_COUNTS, SUM=_COUNTS)


def lenient_utf8(content: Column) -> Column:
    """Decode bytes as UTF-8, leaving out the invalid ones."""
    text = content.cast("string")
    repaired = F.replace(F.make_valid_utf8(text), F.lit(REPLACEMENT), F.lit(""))
    return F.when(F.is_valid_utf8(text), text).otherwise(repaired)


def scan_source_files(spark: SparkSession, root: str, pattern: str = "*.java") -> DataFrame:
    """``source_file`` facts of trees laid out as ``root/<owner__name>/...``.

    Spark's file listing leaves out names that start with ``.`` or ``_`` and files of
    zero length. A corpus landed as ``source_file`` Parquet keeps them, and scans far
    better than one object per source file.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
    )
    return parse_source_files(files, root)


def parse_source_files(files: DataFrame, root: str) -> DataFrame:
    """Files as ``path, content`` into repository key, relative path and text."""
    folder, relative = _below(F.col("path"), root)
    return files.filter(~F.contains("path", F.lit("/.git/")) & (folder != "")).select(
        repository_of(folder).alias("repository"),
        relative.alias("file"),
        lenient_utf8(F.col("content")).alias("text"),
    )


def _below(path: Column, root: str) -> tuple[Column, Column]:
    """First folder below the root, and the path below that folder.

    Scheme and host are ignored on both sides: Spark reports ``file:/data`` for what
    was given as ``/data`` or ``file:///data``.
    """
    location = r"(?:\w+:(?://[^/]*)?)?"
    folder = re.sub(rf"\A{location}", "", root.rstrip("/"))
    pattern = rf"\A{location}\Q{folder}\E/([^/]+)/(.*)\z"
    return F.regexp_extract(path, pattern, 1), F.regexp_extract(path, pattern, 2)


def discover_repositories(paths: DataFrame, root: str) -> DataFrame:
    """Repositories of a path listing: folders below the root that hold ``.git``."""
    folder, relative = _below(F.col("path"), root)
    return (
        paths.select(folder.alias("folder"), relative.alias("relative"))
        .filter(F.rlike("relative", F.lit(r"\A\.git(/|\z)")))
        .select("folder")
        .distinct()
        .orderBy("folder")
        .select(repository_of(F.col("folder")).alias("repository"))
    )


def parse_line_counts(reports: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``loc`` rows of counter reports (``repository, value``); broken JSON is dropped."""
    parsed = reports.select(
        "repository",
        *keep,
        F.from_json(
            "value", LINE_COUNT_JSON, {"columnNameOfCorruptRecord": "unreadable"}
        ).alias("report"),
    ).filter(F.col("report").isNotNull() & F.col("report.unreadable").isNull())
    fields = {
        "files": "SUM.nFiles", "blank": "SUM.blank",
        "comment": "SUM.comment", "code": "SUM.code",
        "java_files": "Java.nFiles", "java_code": "Java.code",
        "java_comment": "Java.comment", "java_blank": "Java.blank",
    }
    return parsed.select(
        "repository",
        *(
            F.coalesce(F.col(f"report.{source}"), F.lit(0)).alias(name)
            for name, source in fields.items()
        ),
        *keep,
    )


def first_available(*sources: DataFrame, key: str = "repository") -> DataFrame:
    """Per key, the whole row of the first source that has one.

    Each source has at most one row per key, so the full joins are one to one.
    """
    names = [name for name in sources[0].columns if name != key]
    rows = [
        source.select(key, F.struct(*names).alias(f"row{position}"))
        for position, source in enumerate(sources)
    ]
    joined = reduce(lambda left, right: left.join(right, key, "full"), rows)
    chosen = F.coalesce(*(F.col(f"row{position}") for position in range(len(rows))))
    return joined.select(key, chosen.alias("row")).select(key, "row.*")
