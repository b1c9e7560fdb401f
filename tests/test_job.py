"""The end-to-end job on landed tables, run twice into the same place."""

from __future__ import annotations

import json

from conftest import dicts
from test_operators import CHANGE, COMMIT, COMMITS, RAW, REPOSITORY, repository

from codestrata.plans import job
from codestrata.sinks.tables import write_csv


def test_job_publishes_every_table(spark, rows, tmp_path):
    landed, published = str(tmp_path / "landed"), str(tmp_path / "published")
    frames = {
        "commit": rows(COMMIT, *COMMITS),
        "file_change": rows(
            CHANGE, ("a/b", "1", 1, "X.java", 3, 1), ("a/b", "2", 0, "X.java", None, None),
            ("a/b", "2", 0, "Y.java", 1, 0),
        ),
        "source_file": rows(
            "repository string, file string, text string",
            ("a/b", "X.java", "class X {}\n"), ("a/b", "XTest.java", "@Test\n\n// org.junit"),
        ),
        "raw_pull_request": rows(
            RAW, ("a/b", 1, "open", "2026-01-01T00:00:00Z", "", "", "ann", 4),
        ),
        "repositories": rows(REPOSITORY, repository("a/b", 1)[:-1], repository("e/f", 2)[:-1]),
        "complexity": rows(
            "repository string, file string, method string, nloc int, ccn int, tokens int,"
            "parameters int, length int",
            ("a/b", "X.java", "m", 10, 4, 50, 1, 12), ("a/b", "X.java", "n", 5, 1, 20, 0, 6),
        ),
        "structure": rows(
            "repository string, file string, type_name string, kind string, is_abstract boolean,"
            "is_interface boolean, methods int, attributes int, extends string, implements string",
            ("a/b", "X.java", "X", "class", False, False, 2, 0, "", ""),
        ),
    }
    for name, frame in frames.items():
        frame.write.parquet(f"{landed}/{name}")
    spark.sql("create database if not exists published")
    for _ in range(2):
        tables = job.run(spark, landed, published, "published")
    mart = dicts(tables["quality_indicators"], "repository")
    assert set(mart) == {"a/b", "c/d", "e/f"}
    row = mart["a/b"]
    assert (row["total_commits"], row["contributors"], row["total_loc"]) == (5, 4, 2)
    assert (row["test_methods"], row["testability"], row["activity_score"]) == (1, 0.5, 26)
    assert (row["avg_ccn"], row["max_ccn"], row["avg_commits_per_pr"]) == (2.5, 4, 4.0)
    spots = [tuple(r) for r in tables["hotspots"].orderBy("file").collect()]
    assert spots == [("a/b", "X.java", 2, 2.5, 5.0), ("a/b", "Y.java", 1, 0.0, 0.0)]
    assert spark.table("published.hotspots").count() == 2
    assert spark.read.parquet(f"{published}/report/metric_series").count() == 15


def test_reported_line_counts_come_first(spark, rows, tmp_path):
    landed = tmp_path / "landed"
    sources = rows(
        "repository string, file string, text string", ("a/b", "X.java", "x"), ("c/d", "X.java", "y\nz")
    )
    sources.write.parquet(f"{landed}/source_file")
    reports = rows(
        "repository string, value string", ("a/b", '{"SUM": {"code": 70}}'), ("c/d", "{broken")
    )
    reports.write.parquet(f"{landed}/line_count_report")
    tables = job.run(spark, str(landed), str(tmp_path / "published"))
    assert {r["repository"]: r["code"] for r in tables["loc"].collect()} == {"a/b": 70, "c/d": 2}


def test_choice_of_repositories(spark, tmp_path):
    def response(name, stars, **other):
        return {"full_name": name, "stargazers_count": stars, "forks_count": 2000, "language": "Java",
                "pushed_at": "2026-05-01T00:00:00Z"} | other

    responses = [response(f"o/r{i:02}", 6000 + i) for i in range(40)]
    responses += [response("o/old", 9000, pushed_at="2001-01-01T00:00:00Z")]
    file = tmp_path / "search.json"
    file.write_text("\n".join(map(json.dumps, responses)))
    job.choose_repositories(spark, str(file), str(tmp_path / "many"), "2026-06-01T00:00:00Z")
    names = [row["value"] for row in spark.read.text(str(tmp_path / "many/repository_list")).collect()]
    assert names == [f"o/r{i}" for i in range(39, 29, -1)]
    assert spark.read.parquet(str(tmp_path / "many/repositories")).count() == 10

    file.write_text("\n".join(map(json.dumps, [response("google/guava", 100), *responses[:3]])))
    job.choose_repositories(spark, str(file), str(tmp_path / "few"), "2026-06-01T00:00:00Z")
    found = spark.read.parquet(str(tmp_path / "few/repositories")).collect()
    assert [(row["full_name"], row["stars"]) for row in found] == [("google/guava", 100)]


def test_job_runs_on_nothing(spark, tmp_path):
    tables = job.run(spark, str(tmp_path / "landed"), str(tmp_path / "published"))
    assert all(frame.isEmpty() for frame in tables.values())
    assert "concentration_risk" in tables["quality_indicators"].columns


def test_job_keeps_the_first_of_duplicate_rows(spark, rows, tmp_path):
    landed = tmp_path / "landed"
    listed = [("a/b", 10, 1), ("a/b", 5, 9), ("c/d", 1, 2)]
    metadata = [(name, "u", stars, forks, 0, "Java", "", "", False, "") for name, stars, forks in listed]
    fields = ", ".join(REPOSITORY.split(", ")[:10])
    rows(fields, *metadata).coalesce(1).write.parquet(f"{landed}/repositories")
    reports = [("a/b", '{"SUM": {"code": 7, "nFiles": 9}}'), ("a/b", '{"SUM": {"code": 70}}')]
    rows("repository string, value string", *reports).coalesce(1).write.parquet(
        f"{landed}/line_count_report"
    )
    tables = job.run(spark, str(landed), str(tmp_path / "published"))
    mart = dicts(tables["quality_indicators"], "repository")
    assert (mart["a/b"]["stars"], mart["a/b"]["forks"], mart["a/b"]["total_loc"]) == (10, 1, 7)
    (counts,) = tables["loc"].collect()
    assert (counts["files"], counts["code"]) == (9, 7)


def test_job_reads_csv(spark, rows, tmp_path):
    landed = tmp_path / "landed"
    write_csv(rows(COMMIT, *COMMITS), f"{landed}/commit.csv", "commit")
    tables = job.run(spark, str(landed), str(tmp_path / "published"), csv=True)
    assert dicts(tables["commits"], "repository")["a/b"]["total_commits"] == 5
