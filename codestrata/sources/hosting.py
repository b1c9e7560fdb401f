"""Landed responses of a code-hosting service: repository and pull-request JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from codestrata.functions.names import non_empty, text_or_blank
from codestrata.schemas import columns, struct
from codestrata.sources.landed import position_in_source

# Superset of the snake_case and camelCase shapes. ``license`` is either an object
# or a plain string, so it is taken as text and told apart when normalised.
_REPOSITORY = """full_name string, fullName string, html_url string, url string,
    stargazers_count long, stargazersCount long, forks_count long, forksCount long,
    open_issues_count long, language string, license string, pushed_at string,
    pushedAt string, archived boolean, isArchived boolean, description string"""
# A record that cannot be read ends up in ``unreadable`` and is left out.
REPOSITORY_JSON = struct(f"{_REPOSITORY}, unreadable string", items=ArrayType(struct(_REPOSITORY)))
_UNREADABLE = {"columnNameOfCorruptRecord": "unreadable"}
# Results in one landed search response; more are an error, as their order would be lost.
RESULTS_PER_RESPONSE = 1 << 20

PULL_REQUEST_JSON = struct(
    """repository string, number long, state string, created_at string, closed_at string,
    merged_at string, link string, items long, unreadable string""",
    user=struct("login string"),
)

# Fixed value: the last page in a pagination header.
LAST_PAGE = r'[?&]page=(\d+)>; rel="last"'


def _parse(lines: DataFrame, schema: StructType, keep: tuple[str, ...]) -> DataFrame:
    record = F.from_json("value", schema, _UNREADABLE)
    return _readable(lines.select(record.alias("record"), *keep).select("record.*", *keep))


def _readable(records: DataFrame) -> DataFrame:
    return records.filter(F.col("unreadable").isNull())


def _results(records: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Records as they are, and the results of search responses in their place.

    The place of a result is that of its response, shifted to make room, plus its number.
    """
    fields = [field for field in records.columns if field not in ("items", "unreadable", *keep)]
    alone = F.array(F.struct(*fields))
    results = F.coalesce("items", alone)
    placed = records.select(*keep, F.posexplode(results).alias("number", "result"))
    number = F.when(
        F.col("number") >= RESULTS_PER_RESPONSE,
        F.raise_error(F.lit("a search response holds too many results")).cast("int"),
    ).otherwise(F.col("number"))
    shifted = ((F.col(name) * RESULTS_PER_RESPONSE + number).alias(name) for name in keep)
    return placed.select("result.*", *shifted)


def scan_repository_json(
    spark: SparkSession, path: str, sequence: str | None = None
) -> DataFrame:
    """One JSON object per line, either shape or a search response, normalised.

    ``sequence`` names an extra column that orders the repositories as they lie.
    """
    raw = spark.read.schema(REPOSITORY_JSON).options(**_UNREADABLE).json(path)
    keep = () if sequence is None else (sequence,)
    placed = raw.select("*", *(position_in_source().alias(name) for name in keep))
    return normalise_repository(_results(_readable(placed), keep), keep)


def parse_repository_json(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Like ``scan_repository_json`` for JSON text already in column ``value``."""
    return normalise_repository(_parse(lines, REPOSITORY_JSON, keep), keep)


def normalise_repository(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Merge the two shapes into the ``repositories`` schema with a default per field."""
    licence = F.when(
        F.startswith("license", F.lit("{")), F.get_json_object("license", "$.spdx_id")
    ).otherwise(F.col("license"))
    fields = {
        "full_name": F.coalesce(non_empty(F.col("full_name")), non_empty(F.col("fullName"))),
        "url": F.coalesce(non_empty(F.col("html_url")), non_empty(F.col("url"))),
        "stars": F.coalesce("stargazers_count", "stargazersCount", F.lit(0)),
        "forks": F.coalesce("forks_count", "forksCount", F.lit(0)),
        "open_issues": F.coalesce("open_issues_count", F.lit(0)),
        "language": text_or_blank(F.col("language")),
        "license": text_or_blank(licence),
        "pushed_at": text_or_blank(
            F.coalesce(non_empty(F.col("pushed_at")), F.col("pushedAt"))
        ),
        "archived": F.coalesce("archived", "isArchived", F.lit(False)),
        "description": F.replace(
            text_or_blank(F.col("description")), F.lit("\n"), F.lit(" ")
        ),
    }
    return raw.select(*(fields[name].alias(name) for name in columns("repositories")), *keep)


def scan_pull_request_json(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(PULL_REQUEST_JSON).options(**_UNREADABLE).json(path)
    return flatten_pull_request(_readable(raw))


def parse_pull_request_json(lines: DataFrame) -> DataFrame:
    return flatten_pull_request(_parse(lines, PULL_REQUEST_JSON, ()))


def flatten_pull_request(raw: DataFrame) -> DataFrame:
    """Raw pull requests with blanks for missing text and the commit count resolved.

    ``link`` and ``items`` describe the landed commit-list response of the pull
    request; both are NULL when that response was never requested.
    """
    return raw.select(
        "repository",
        "number",
        text_or_blank(F.col("state")).alias("state"),
        text_or_blank(F.col("created_at")).alias("created_at"),
        text_or_blank(F.col("closed_at")).alias("closed_at"),
        text_or_blank(F.col("merged_at")).alias("merged_at"),
        text_or_blank(F.col("user.login")).alias("author"),
        result_count(F.col("link"), F.col("items")).alias("commits"),
    )


def result_count(link: Column, items: Column) -> Column:
    """Number of results behind a paged response of page size one.

    The pagination header names the last page; without it the page at hand is all.
    """
    last_page = non_empty(F.regexp_extract(link, LAST_PAGE, 1)).cast("long")
    return F.coalesce(last_page, items)
