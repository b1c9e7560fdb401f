"""Author mapping, day bitmaps and the merging of states."""

from __future__ import annotations

import pytest

from codestrata.operators import commit_state, history
from codestrata.sources import history_text

COMMIT = (
    "repository string, sha string, parent_count int, author_name string, author_email string,"
    " committed_at_iso string, on_head boolean, is_head boolean"
)
CHANGE = "repository string, sha string, log_seq long, file string, added long, removed long"


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("line, expected", [
    ("Jane Doe <jane@x.org>", ("Jane Doe", None, None, "jane@x.org")),
    ("<jane@x.org> <old@x.org>", (None, "jane@x.org", None, "old@x.org")),
    ("  Jane  <jane@x.org>\t<old@x.org>  # why", ("Jane", "jane@x.org", None, "old@x.org")),
    ("Jane <j@x> Old Name <old@x>", ("Jane", "j@x", "Old Name", "old@x")),
    ("Jane <j@x> <>", ("Jane", "j@x", None, "")),
    ("# Jane <j@x>", None), ("", None), ("no address", None), ("Jane j@x>", None),
])
def test_mapping_lines(spark, line, expected):
    frame = spark.createDataFrame([("r", 1, line)], "repository string, place long, value string")
    found = [tuple(row)[2:] for row in history_text.parse_author_mapping(frame).collect()]
    assert found == ([expected] if expected else [])


def test_mapping_files(spark, tmp_path):
    (tmp_path / "o__r.mailmap").write_text("Late <a@x>\nLater <A@X>\nTeam <t@x> Bob <b@x>\n")
    mapping = history_text.scan_author_mapping(spark, str(tmp_path))
    authors = [("o/r", "Ann", "a@x"), ("o/r", "BOB", "B@x"), ("o/r", "Bo", "b@x"),
               ("o/s", "Ann", "a@x"), ("o/r", None, None)]
    frame = spark.createDataFrame(
        [(r, "s", 1, n, e, "2024-01-01", True, False) for r, n, e in authors * 2], COMMIT)
    assert rows(history.developer_commits(frame, mapping)) == sorted([
        ("o/r", "Later", "a@x", 2), ("o/r", "Team", "t@x", 2), ("o/r", "Bo", "b@x", 2),
        ("o/s", "Ann", "a@x", 2), ("o/r", None, None, 2)], key=str)


def test_a_name_and_address_go_before_an_address(spark):
    mapping = spark.createDataFrame(
        [("r", 1, None, "n@x", "Ann", "a@x"), ("r", 2, "General", "g@x", None, "a@x"),
         ("r", 3, "Renamed", None, None, "a@x")],
        "repository string, place long, proper_name string, proper_email string,"
        " commit_name string, commit_email string")
    people = spark.createDataFrame([("r", "ann", "A@x", 1), ("r", "Bea", "a@x", 2)],
                                   "repository string, developer string, email string, n int")
    found = history.mapped_authors(people, mapping, "developer", "email")
    # The line with Ann's name states no name, and the general line is not asked.
    assert rows(found) == [("r", "Renamed", "g@x", 2), ("r", "ann", "n@x", 1)]
    assert rows(history.mapped_authors(people, mapping.limit(0), "developer", "email")) == rows(people)


LOG = [
    ("r", "1", 0, "A", "a@x", "2020-02-29T10:00:00+00:00", True, False),
    ("r", "2", 1, "B", "b@x", "2020-02-29T23:59:00+09:00", True, False),
    ("r", "3", 2, "A", "a@x", "0001-01-01T00:00:00Z", True, False),
    ("r", "4", 1, "A", "a@x", "9999-12-31T00:00:00Z", True, False),
    ("r", "5", 1, "A", "a@x", "2021-13-45 odd", True, False),
    ("r", "6", 1, None, None, None, True, False),
    ("r", "7", 1, "A", "a@x", "2021-1-2", False, False),
    ("r", "8", 0, "A", "a@x", "1950-06-01T00:00:00Z", True, True),
    ("s", "9", 1, "A", "a@x", "2020-01-01T00:00:00Z", False, False),
    ("t", "10", 0, "A", "a@x", "2020-1-1", True, True),
    ("t", "11", 1, "A", "a@x", "2020-01-01", True, False),
]
CHANGES = [("r", str(i), 10 + i, f"f{i % 3}", i, None) for i in range(1, 9)]


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_states_merge_to_that_of_the_whole_log(spark, parts):
    commits, changes = spark.createDataFrame(LOG, COMMIT), spark.createDataFrame(CHANGES, CHANGE)
    states = [
        commit_state.state_of(
            commits.where(f"cast(sha as int) % {parts} = {part}"),
            changes.where(f"cast(sha as int) % {parts} = {part}"), 0)
        for part in range(parts)
    ]
    state = commit_state.merged(*reversed(states))
    assert rows(commit_state.commit_summary(state)) == rows(history.commit_summary(commits))
    assert rows(state.developers) == rows(history.developer_commits(commits))
    assert rows(state.files) == rows(history.file_churn(changes))


def test_active_days_are_those_written(spark):
    commits = spark.createDataFrame(LOG, COMMIT)
    state = commit_state.state_of(commits, spark.createDataFrame([], CHANGE), 0)
    found = {r.repository: r.distinct_active_days for r in commit_state.commit_summary(state).collect()}
    written = {r: len({row[5][:10] for row in LOG if row[0] == r and row[6] and row[5]})
               for r in "rst"}
    assert found == written


def test_the_head_of_the_latest_fetch_counts(spark, tmp_path):
    def fetch(number, *days):
        commits = spark.createDataFrame(
            [("r", day, 0 if day < "2020-01-02" else 1, "A", "a", day, True, day == days[-1])
             for day in days], COMMIT)
        return commit_state.state_of(commits, spark.createDataFrame([], CHANGE), number)

    first = fetch(1, "2020-01-01", "2020-01-05")
    commit_state.write_state(first, str(tmp_path / "1"))
    both = commit_state.merged(
        fetch(2, "2020-01-03", "2020-01-04"), commit_state.scan_state(spark, str(tmp_path / "1")))
    commit_state.write_state(both, str(tmp_path / "2"))
    landed = commit_state.scan_state(spark, str(tmp_path / "2"))
    assert rows(commit_state.commit_summary(landed)) == [
        ("r", 4, "2020-01-01", "2020-01-04", 3, 4)]
    empty = commit_state.merged(fetch(3, "2020-01-01"), landed)
    assert commit_state.commit_summary(empty).first().total_commits == 5
