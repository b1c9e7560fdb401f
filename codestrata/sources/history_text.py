"""Text printed by the version-control tool: change logs and author summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.names import repository_of, strip
from codestrata.functions.numeric import coerce_count
from codestrata.functions.text import line_slots, with_line_feeds
from codestrata.operators.reachability import is_head, with_head
from codestrata.schemas import columns
from codestrata.sources.landed import position_in_source

# The marker in front of each commit id, the number of tab-separated
# parts of a change line, and the layout of an author line.
COMMIT_MARKER = "C"
CHANGE_PARTS = 3
AUTHOR_LINE = r"(?U)^\s*(\d+)\s+(.+?)\s+<(.*?)>\s*$"


def repository_from_file_name() -> Column:
    """Key of a per-repository file named ``owner__name`` plus any extension."""
    return repository_of(F.regexp_extract(F.col("_metadata.file_name"), r"\A(.+?)(\.\w+)?\z", 1))


# Fixed value: what separates the fields of a landed commit line.
FIELD_MARK = "\x1f"


def scan_commit_log(spark: SparkSession, every: str, head: str | None = None) -> DataFrame:
    """``commit`` facts of a landed log of all commits.

    A line holds repository, commit id, parent ids, author name and address, commit date and
    references, with ``FIELD_MARK`` between them. Which commits the head reaches is found from
    their parents, unless a second log states it, with repository and commit id on a line.
    """

    def fields(path: str, *names: str) -> DataFrame:
        parts = F.split("value", FIELD_MARK)
        rows = spark.read.text(path).filter(F.size(parts) >= len(names))
        return rows.select(*(parts[i].alias(name) for i, name in enumerate(names)))

    commits = fields(every, "repository", "sha", "parents", "author_name", "author_email",
                     "committed_at_iso", "refs")
    parents = F.filter(F.split("parents", " "), lambda parent: parent != "")
    commits = commits.withColumn("parents", parents)
    if head is None:
        placed = with_head(commits)
    else:
        stated = fields(head, "repository", "sha").distinct().withColumn("on_head", F.lit(True))
        placed = commits.join(stated, ["repository", "sha"], "left").withColumns({
            "on_head": F.coalesce("on_head", F.lit(False)), "is_head": is_head(F.col("refs")),
        })
    return placed.withColumn("parent_count", F.size("parents")).select(*columns("commit"))


def scan_change_log(spark: SparkSession, path: str) -> DataFrame:
    """``file_change`` facts of change logs, one file per repository.

    The separator is the marker at a line start, so a row is a whole commit and the
    files split at commits like any other text. Change lines start with a digit or
    ``-``, never with the marker.
    """
    records = spark.read.text(path, lineSep=f"\n{COMMIT_MARKER}").select(
        repository_from_file_name().alias("repository"),
        position_in_source().alias("log_seq"),
        "value",
    )
    return parse_change_log(records)


def parse_change_log(records: DataFrame) -> DataFrame:
    """Explode commit records (``repository, log_seq, value``) into change lines.

    Counts that are not all digits, as for binary files, become NULL.
    """
    # Only the first record of a file still carries the marker.
    unmarked = F.when(
        F.startswith("value", F.lit(COMMIT_MARKER)), F.substr("value", F.lit(2))
    ).otherwise(F.col("value"))
    record = records.select("repository", "log_seq", unmarked.alias("record"))
    # The outer form keeps the optimizer from evaluating the split a second time in a
    # filter for empty arrays; the next filter drops everything but change lines.
    lines = record.select(
        "repository", "log_seq", line_slots(with_line_feeds(F.col("record"))).alias("lines")
    ).select(
        "repository",
        strip(F.get("lines", F.lit(0))).alias("sha"),
        "log_seq",
        F.explode_outer("lines").alias("line"),
    )
    parts = lines.select("repository", "sha", "log_seq", F.split("line", "\t").alias("parts"))
    return parts.filter(F.size("parts") == CHANGE_PARTS).select(
        "repository",
        "sha",
        "log_seq",
        F.get("parts", F.lit(2)).alias("file"),
        coerce_count(F.get("parts", F.lit(0))).alias("added"),
        coerce_count(F.get("parts", F.lit(1))).alias("removed"),
    )


def scan_author_summary(spark: SparkSession, path: str) -> DataFrame:
    """``developers`` rows of author summaries, one file per repository."""
    lines = spark.read.text(path).select(
        repository_from_file_name().alias("repository"), "value"
    )
    return parse_author_summary(lines)


def parse_author_summary(lines: DataFrame) -> DataFrame:
    """``count  name <email>`` lines; anything else is dropped."""
    def part(group: int) -> Column:
        return F.regexp_extract("value", AUTHOR_LINE, group)

    return lines.filter(F.rlike("value", F.lit(AUTHOR_LINE))).select(
        "repository",
        strip(part(2)).alias("developer"),
        strip(part(3)).alias("email"),
        part(1).cast("long").alias("commits"),
    )


# Fixed value: a line of an author mapping file, with one or two names and addresses.
MAPPING_LINE = r"\A\s*([^<#][^<]*?)?\s*<([^<>]*)>(?:\s*([^<]*?)\s*<([^<>]*)>)?"


def scan_author_mapping(spark: SparkSession, path: str) -> DataFrame:
    """``author_mapping`` rows of mapping files, one file per repository."""
    lines = spark.read.text(path).select(
        repository_from_file_name().alias("repository"), position_in_source().alias("place"),
        "value",
    )
    return parse_author_mapping(lines)


def parse_author_mapping(lines: DataFrame) -> DataFrame:
    """Mapping lines (``repository, place, value``) into proper and committed identities.

    ``Name <address>`` states the name for an address, and with a second address before it,
    the address too; a second name limits the line to commits with that name. Other lines, as
    comments, are dropped.
    """
    def part(group: int) -> Column:
        return F.nullif(strip(F.regexp_extract("value", MAPPING_LINE, group)), F.lit(""))

    two = F.rlike("value", F.lit(MAPPING_LINE.removesuffix("?")))
    return lines.filter(F.rlike("value", F.lit(MAPPING_LINE))).select(
        "repository",
        "place",
        part(1).alias("proper_name"),
        F.when(two, part(2)).alias("proper_email"),
        F.when(two, part(3)).alias("commit_name"),
        F.coalesce(F.when(two, part(4)).otherwise(part(2)), F.lit("")).alias("commit_email"),
    )
