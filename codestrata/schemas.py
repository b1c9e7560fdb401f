"""Explicit schemas of every landed and derived table.

Nothing is inferred: a file whose header or types differ is rejected at read time.
"""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

_TYPES: dict[str, DataType] = {
    "string": StringType(),
    "long": LongType(),
    "int": IntegerType(),
    "double": DoubleType(),
    "boolean": BooleanType(),
}


def struct(fields: str, **nested: DataType) -> StructType:
    """Struct of nullable ``name type`` pairs; needs no session, unlike DDL strings."""
    pairs = (field.split() for field in fields.split(","))
    flat = [StructField(name, _TYPES[kind]) for name, kind in pairs]
    return StructType(flat + [StructField(name, kind) for name, kind in nested.items()])


# The tables and their columns.
_FIELDS = {
    # Base facts landed by the collectors.
    "commit": """repository string, sha string, parent_count int, author_name string,
        author_email string, committed_at_iso string, on_head boolean, is_head boolean""",
    "file_change": """repository string, sha string, log_seq long, file string,
        added long, removed long""",
    "source_file": "repository string, file string, text string",
    "raw_pull_request": """repository string, number long, state string, created_at string,
        closed_at string, merged_at string, author string, commits long""",
    "line_count_report": "repository string, value string",
    # Published tables.
    "repositories": """full_name string, url string, stars long, forks long, open_issues long,
        language string, license string, pushed_at string, archived boolean,
        description string""",
    "commits": """repository string, total_commits long, first_commit string,
        last_commit string, span_days int, distinct_active_days int""",
    "developers": "repository string, developer string, email string, commits long",
    "files": """repository string, file string, commits long, lines_added long,
        lines_removed long""",
    "pull_requests": """repository string, number long, state string, created_at string,
        closed_at string, merged_at string, hours_to_close double, commits long,
        author string""",
    "loc": """repository string, files long, blank long, comment long, code long,
        java_files long, java_code long, java_comment long, java_blank long""",
    "complexity": """repository string, file string, method string, nloc int, ccn int,
        tokens int, parameters int, length int""",
    "structure": """repository string, file string, type_name string, kind string,
        is_abstract boolean, is_interface boolean, methods int, attributes int,
        extends string, implements string""",
    "tests": """repository string, test_files long, test_methods long, main_loc long,
        test_loc long, test_to_main_ratio double, frameworks string""",
    "quality_indicators": """repository string, stars long, forks long, total_commits long,
        active_days int, contributors long, top5_commit_share_pct double,
        concentration_risk string, total_loc long, avg_ccn double, max_ccn int,
        avg_method_nloc double, avg_method_params double, classes long, interfaces long,
        methods long, inheritance_links long, test_methods long, testability double,
        pr_open long, pr_closed long, avg_commits_per_pr double, avg_pr_close_hours double,
        activity_score long""",
    "hotspots": """repository string, file string, commits long, avg_ccn double,
        hotspot_score double""",
}

SCHEMAS: dict[str, StructType] = {name: struct(fields) for name, fields in _FIELDS.items()}

# Tables a consolidation publishes, in publication order.
PUBLISHED = (
    "repositories", "commits", "developers", "files", "pull_requests", "loc",
    "structure", "complexity", "tests", "quality_indicators", "hotspots",
)


def columns(table: str) -> list[str]:
    return SCHEMAS[table].fieldNames()
