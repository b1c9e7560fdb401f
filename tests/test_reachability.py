"""Commits that the head reaches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from codestrata.operators import history, reachability
from codestrata.sources import history_text

SCHEMA = "repository string, sha string, parents array<string>, refs string"


def brute(rows):
    parents = {}
    for repository, sha, own, _ in rows:
        parents.setdefault((repository, sha), []).extend(own or [])
    heads = [(r, s) for r, s, _, refs in rows
             if any(part.split(" ->")[0] == "HEAD" for part in (refs or "").split(", "))]
    seen, left = set(), heads
    while left:
        at = left.pop()
        if at in parents and at not in seen:
            seen.add(at)
            left += [(at[0], parent) for parent in parents[at]]
    return seen


def found(spark, rows):
    frame = reachability.reached(spark.createDataFrame(rows, SCHEMA))
    listed = [tuple(row) for row in frame.collect()]
    assert len(listed) == len(set(listed))
    return set(listed)


def test_random_graphs(spark):
    random.seed(6)
    rows = []
    for number in range(30):
        n = random.randint(1, 40)
        for i in range(n):
            own = random.sample(range(i), min(i, random.choice([0, 1, 1, 1, 2, 3])))
            refs = "HEAD -> main" if i == n - 1 else random.choice([None, "", "tag: x", "AHEAD"])
            rows.append((f"r{number}", f"c{i}", [f"c{p}" for p in own], refs))
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [
        ("a", "1", None, None), ("a", "2", ["1", "gone"], "HEAD, tag: v"), ("a", "3", ["2"], ""),
        ("b", "1", [], "main"), ("c", "2", ["1"], "HEAD"), ("c", "2", ["0"], ""),
        ("c", "0", [], ""), ("c", "1", [], ""),
    ]
    assert found(spark, rows) == {("a", "1"), ("a", "2"), ("c", "0"), ("c", "1"), ("c", "2")}
    assert found(spark, []) == set()


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(
        reachability, "staged",
        lambda frame, label, write=reachability.staged: written.append(label) or write(frame, label),
    )
    n = 100_000
    commits = spark.range(n).select(
        F.lit("r").alias("repository"), F.col("id").cast("string").alias("sha"),
        F.when(F.col("id") > 0, F.array((F.col("id") - 1).cast("string"))).alias("parents"),
        F.when(F.col("id") == n - 10, "HEAD -> main").alias("refs"),
    )
    assert reachability.reached(commits).count() == n - 9
    assert len(written) < 40


def test_a_cycle_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(reachability, "LONGEST", 4)
    rows = [("a", "1", ["2"], "HEAD"), ("a", "2", ["1"], "")]
    with pytest.raises(ValueError, match="lead back"):
        found(spark, rows)


def test_one_log_gives_the_commit_summary(spark, tmp_path):
    mark = history_text.FIELD_MARK
    lines = [
        ("o/r", "c4", "c2 c3", "A", "a@x", "2024-01-05T10:00:00+00:00", "HEAD -> main"),
        ("o/r", "c3", "c1", "B", "b@x", "2024-01-04T10:00:00+00:00", "side"),
        ("o/r", "c2", "c1", "A", "a@x", "2024-01-02T10:00:00+00:00", ""),
        ("o/r", "c1", "", "A", "a@x", "2024-01-01T10:00:00+00:00", ""),
        ("o/r", "c9", "c1", "A", "a@x", "2024-02-01T10:00:00+00:00", "unmerged"),
    ]
    log = tmp_path / "every.log"
    log.write_text("\n".join(mark.join(line) for line in lines) + "\n")
    commits = history_text.scan_commit_log(spark, str(log))
    (row,) = history.commit_summary(commits).collect()
    assert (row.total_commits, row.span_days, row.distinct_active_days) == (4, 4, 4)
    assert row.first_commit.startswith("2024-01-01") and row.last_commit.startswith("2024-01-05")
    assert sum(r.commits for r in history.developer_commits(commits).collect()) == 4


def test_random_graphs_made_smaller(spark, monkeypatch):
    random.seed(8)
    monkeypatch.setattr(reachability, "SMALL", 0)
    rows = []
    for number in range(30):
        n = random.randint(1, 40)
        for i in range(n):
            # Recent parents, so that there are chains, and branches that are merged.
            near = range(max(0, i - 4), i)
            own = random.sample(near, min(len(near), random.choice([0, 1, 1, 1, 1, 2])))
            refs = "HEAD -> main" if i == n * 3 // 4 else ""
            rows.append((f"r{number}", f"c{i}", [f"c{p}" for p in own], refs))
    # Rows that come twice, and a key with other parents.
    rows += rows[:100] + [("r1", "c0", ["gone"], ""), ("r2", "c9", ["c1", "c2"], None)]
    assert found(spark, rows) == brute(rows)


def test_a_cycle_made_smaller_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(reachability, "LONGEST", 6)
    monkeypatch.setattr(reachability, "SMALL", 0)
    rows = [("a", str(i), [str((i + 1) % 9)], "HEAD" if i == 3 else "") for i in range(9)]
    with pytest.raises(ValueError, match="lead back"):
        found(spark, rows)


def test_what_is_written_grows_with_the_commits(spark, monkeypatch):
    monkeypatch.setattr(reachability, "SMALL", 1000)
    written = []

    def counted(frame, label, write=reachability.staged):
        table = write(frame, label)
        written.append(table.count())
        return table

    monkeypatch.setattr(reachability, "staged", counted)

    def per_commit(n):
        written.clear()
        commits = spark.range(n).select(
            F.lit("r").alias("repository"), F.col("id").cast("string").alias("sha"),
            F.when(F.col("id") > 0, F.array((F.col("id") - 1).cast("string"))).alias("parents"),
            F.when(F.col("id") == n - 10, "HEAD -> main").alias("refs"),
        )
        assert reachability.reached(commits).count() == n - 9
        return sum(written) / n

    # Pointers of all lengths alone took log2(n) rows a commit, 13 and 16 here.
    small, large = per_commit(8_000), per_commit(64_000)
    assert large < 1.2 * small and large < 12
