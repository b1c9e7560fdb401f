"""No hidden limits, no quadratic patterns, and plans that read an input once."""

from __future__ import annotations

import time

import pytest
from conftest import dicts

from codestrata.operators import code, history, pull_requests
from codestrata.sinks.tables import write_parquet
from codestrata.sources import hosting, landed
from workload import mart_queries, pull_request_queries, source_queries

RAW = """repository string, number long, state string, created_at string, closed_at string,
    merged_at string, author string, commits long"""
SF_DIR = "/root/testdata/sf0.001"


def test_every_pull_request_counts(rows):
    raw = rows(RAW, *(("a/b", i, "open", "2026-01-01T00:00:00Z", "", "", "x", 2) for i in range(1000)))
    facts = pull_requests.pull_request_facts(raw)
    (health,) = pull_requests.pull_request_health(facts).collect()
    assert (health["pr_open"], health["avg_commits_per_pr"]) == (1000, 2.0)
    assert facts.where("commits is not null").count() == 1000
    limited = pull_requests.pull_request_facts(raw, newest=300, counted=150)
    assert (limited.count(), limited.where("commits is not null").count()) == (300, 150)


@pytest.mark.parametrize("values, mean", [
    ([2e12, 2e12], 2e12), ([9e11] * 12, 9e11), ([0.01, 0.03], 0.02), ([4e18, 1.0], 2e18),
    ([None, 5.0], 5.0), ([float("nan"), float("inf"), 3.0], 3.0), ([2.0**91] * 2, 2.0**91),
])
def test_means_of_any_size(rows, values, mean):
    facts = rows("repository string, state string, commits double, hours_to_close double",
                 *(("a/b", "open", value, value) for value in values))
    (health,) = pull_requests.pull_request_health(facts).collect()
    assert health["avg_commits_per_pr"] == mean


def test_a_value_too_large_for_an_exact_mean_is_an_error(rows):
    facts = rows("repository string, state string, commits double, hours_to_close double",
                 ("a/b", "open", 1e30, 1.0), ("a/b", "open", 1.0, 1.0))
    with pytest.raises(Exception, match="10\\*\\*28"):
        pull_requests.pull_request_health(facts).collect()


def test_an_unreadable_root_date_is_not_the_first(rows):
    commits = rows(
        "repository string, sha string, parent_count int, author_name string, author_email string,"
        " committed_at_iso string, on_head boolean, is_head boolean",
        ("a/b", "1", 0, "n", "e", "2020-01-02T00:00:00Z", True, False),
        ("a/b", "2", 0, "n", "e", "garbage", True, False),
        ("a/b", "3", 1, "n", "e", "2020-01-04T00:00:00Z", True, True),
    )
    (row,) = history.commit_summary(commits).collect()
    assert (row["first_commit"], row["span_days"]) == ("2020-01-02T00:00:00Z", 2)


@pytest.mark.parametrize("text, found", [
    ("class A < " + "x" * 200_000, 0),
    ("class A < " + "x" * 200_000 + " {", 0),
    ("static " * 100_000 + "class A {", 1),
    ("static " * 100_000 + "x {", 0),
    ("class A extends " * 100_000, 0),
    ("class A extends " * 100_000 + "{", 1),
    ("class A" + "<T" * 5000 + ">" * 5000 + " extends B<C<D<E<F<G>>>>> {", 1),
    ("class A" + " " * 200_000 + "extends B {", 1),
])
def test_type_declarations_take_linear_time(rows, text, found):
    sources = rows("repository string, file string, text string", ("r", "f", text))
    started = time.perf_counter()
    got = code.type_declarations(sources).collect()
    assert len(got) == found and time.perf_counter() - started < 20


def test_rows_of_parquet_are_placed_in_order(spark, tmp_path):
    path = str(tmp_path / "loc")
    names = [f.name for f in landed.SCHEMAS["loc"].fields if f.name != "repository"]
    constant = [f"cast(7 as long) as {name}" for name in names if name != "files"]
    made = spark.range(200_000).coalesce(1).selectExpr("'a/b' as repository", "id as files", *constant)
    made.write.option("parquet.block.size", 65536).parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = landed.scan_parquet(spark, path, "loc", "place")
        assert rows.rdd.getNumPartitions() > 3
        assert rows.select("place").distinct().count() == 200_000
        assert rows.where("place.row <> files").isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    write_parquet(rows.limit(0), path + "_none", "loc")
    assert landed.scan_parquet(spark, path + "_none", "loc", "place").isEmpty()


def test_search_responses_are_taken_apart(spark, tmp_path):
    file = tmp_path / "found.json"
    file.write_text(
        '{"total_count": 2, "items": [{"full_name": "a/b", "stargazers_count": 3},'
        ' {"full_name": "c/d"}]}\n{"full_name": "e/f"}\n{broken\n'
    )
    found = dicts(hosting.scan_repository_json(spark, str(file), "seq").orderBy("seq"))
    assert [(row["full_name"], row["stars"]) for row in found] == [("a/b", 3), ("c/d", 0), ("e/f", 0)]


def test_search_pages_do_not_grow_with_the_table(spark):
    rows = spark.range(1, 10_001).selectExpr(
        "id as seq", "'r' || id as full_name", "id as stars", "0L as forks", "false as archived"
    )
    sizes = [row.total_count for row in source_queries.search_pages(rows).collect()]
    assert max(sizes) <= 100 and sum(sizes) == 10_000


def scans(frame, table):
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    return sum("Relation" in line and table in line for line in plan.splitlines())


def test_plans_read_an_input_once(spark):
    mart = mart_queries.mart(spark, SF_DIR)
    assert scans(mart, "p_partkey") == 2  # the source texts and the structure table
    assert scans(pull_request_queries.candidate_repositories(spark, SF_DIR), "c_custkey") == 2
