"""Readers and writers on small files."""

from __future__ import annotations

import json

import pytest
from conftest import dicts

from codestrata.operators import code, history
from codestrata.schemas import SCHEMAS, columns
from codestrata.session import shared_folder
from codestrata.sinks import tables as sinks
from codestrata.sources import history_text, hosting, landed, trees

COMMITS = [
    ("a/b", 785, "2018-10-06T19:38:31+08:00", "2026-05-03T08:58:41+08:00", 2765, 441),
    ("NA", 0, None, None, 0, 0),
    ("null", 1, None, None, 0, 1),
]


def test_csv_round_trip_keeps_values_and_blanks(spark, tmp_path):
    path = str(tmp_path / "commits")
    for _ in range(2):
        sinks.write_csv(spark.createDataFrame(COMMITS, SCHEMAS["commits"]), path, "commits")
    back = landed.scan_csv(spark, path, "commits")
    assert back.schema == SCHEMAS["commits"]
    assert sorted(map(tuple, back.collect()), key=str) == sorted(COMMITS, key=str)


def test_csv_quotes_line_breaks_and_non_ascii(spark, tmp_path):
    file = tmp_path / "repositories.csv"
    file.write_text(
        ",".join(columns("repositories")) + "\n"
        'o/r,https://x,10,2,3,Java,MIT,2026-04-18T18:23:33Z,False,"say ""hi"",\rthere 中"\n'
        "o/s,https://y,1,2,3,Java,,2026-04-18T18:23:33Z,True,\n",
        encoding="utf-8",
        newline="",
    )
    found = dicts(landed.scan_csv(spark, str(file), "repositories"), "full_name")
    assert found["o/r"]["description"].replace("\r", "\n") == 'say "hi",\nthere 中'
    assert (found["o/r"]["archived"], found["o/s"]["archived"]) == (False, True)
    assert (found["o/s"]["license"], found["o/s"]["description"]) == (None, None)


def test_pointer_file_is_rejected(spark, tmp_path):
    file = tmp_path / "complexity.csv"
    file.write_text("version https://example.org/spec/v1\noid sha256:0\nsize 105845899\n")
    with pytest.raises(Exception, match="schema size: 8"):
        landed.scan_csv(spark, str(file), "complexity").collect()


def test_unreadable_value_is_rejected(spark, tmp_path):
    file = tmp_path / "developers.csv"
    file.write_text("repository,developer,email,commits\na/b,x,y,many\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        landed.scan_csv(spark, str(file), "developers").collect()


@pytest.mark.parametrize("scan", [landed.scan_csv, landed.scan_parquet])
def test_absent_table_is_empty_and_typed(spark, tmp_path, scan):
    frame = scan(spark, str(tmp_path / "nowhere"), "files")
    assert frame.schema == SCHEMAS["files"] and frame.isEmpty()
    numbered = scan(spark, str(tmp_path / "nowhere"), "files", "ingest_seq")
    assert numbered.columns == [*columns("files"), "ingest_seq"]


def test_empty_file_is_an_empty_table(spark, tmp_path):
    (tmp_path / "files.csv").write_text("")
    assert landed.scan_csv(spark, str(tmp_path / "files.csv"), "files").isEmpty()


def test_sequence_follows_the_file_across_splits(spark, tmp_path):
    file = tmp_path / "developers.csv"
    lines = [f"a/b,dev{i},{i}@x,{i}" for i in range(5000)]
    file.write_text("repository,developer,email,commits\n" + "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        numbered = landed.scan_csv(spark, str(file), "developers", "ingest_seq")
        assert numbered.rdd.getNumPartitions() > 4
        ordered = [row["commits"] for row in numbered.orderBy("ingest_seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert ordered == list(range(5000))


def test_repository_list(spark, tmp_path):
    file = tmp_path / "repos.txt"
    file.write_text("# head\na/b\n\n  c/d  \n #kept\n\t\n#x\ne/f\n")
    found = landed.scan_repository_list(spark, str(file)).orderBy("seq").collect()
    assert [row["repository"] for row in found] == ["a/b", "c/d", "#kept", "e/f"]


def test_repository_json_in_both_shapes(spark, tmp_path):
    records = [
        {"full_name": "a/b", "html_url": "u", "stargazers_count": 5, "forks_count": 2,
         "open_issues_count": 1, "language": "Java", "license": {"spdx_id": "MIT", "key": "mit"},
         "pushed_at": "2026-01-01T00:00:00Z", "archived": False, "description": "x\ny"},
        {"fullName": "c/d", "url": "v", "stargazersCount": 7, "forksCount": 3,
         "pushedAt": "2026-01-02T00:00:00Z", "isArchived": True, "language": None,
         "description": None, "license": "GPL"},
        {"full_name": "", "fullName": "e/f", "license": None},
    ]
    file = tmp_path / "repos.json"
    file.write_text("\n".join(map(json.dumps, records)))
    found = dicts(hosting.scan_repository_json(spark, str(file)), "full_name")
    assert tuple(found["a/b"].values()) == (
        "a/b", "u", 5, 2, 1, "Java", "MIT", "2026-01-01T00:00:00Z", False, "x y",
    )
    assert tuple(found["c/d"].values()) == (
        "c/d", "v", 7, 3, 0, "", "GPL", "2026-01-02T00:00:00Z", True, "",
    )
    assert tuple(found["e/f"].values()) == ("e/f", None, 0, 0, 0, "", "", "", False, "")


def test_pull_request_json(spark, tmp_path):
    last = '<https://x/c?per_page=1&page=2>; rel="next", <https://x/c?per_page=1&page=17>; rel="last"'
    records = [
        {"repository": "a/b", "number": 1, "state": "closed", "created_at": "c", "closed_at": "d",
         "merged_at": None, "user": {"login": "me", "id": 1}, "link": last, "items": 1},
        {"repository": "a/b", "number": 2, "state": "open", "user": None, "items": 1},
        {"repository": "a/b", "number": 3, "state": "open"},
    ]
    file = tmp_path / "prs.json"
    file.write_text("\n".join(map(json.dumps, records)))
    found = dicts(hosting.scan_pull_request_json(spark, str(file)), "number")
    assert [found[n]["commits"] for n in (1, 2, 3)] == [17, 1, None]
    assert [found[n]["author"] for n in (1, 2, 3)] == ["me", "", ""]
    assert found[1]["merged_at"] == "" and found[2]["closed_at"] == ""


CHANGE_LOG = """C{0}1

3\t1\tsrc/A.java
-\t-\tlogo.png

C{0}2

10\t0\tsrc/A.java
0\t4\ta/{{x => y}}/C.java
not a change
C{0}3
C{0}4

7\t7\tCHANGES.md
"""


def test_change_log(spark, tmp_path):
    (tmp_path / "o__r.log").write_text(CHANGE_LOG.format("abc"))
    (tmp_path / "o__s.log").write_text("")
    changes = history_text.scan_change_log(spark, str(tmp_path))
    found = changes.orderBy("log_seq", "file").select("sha", "file", "added", "removed").collect()
    assert [tuple(row) for row in found] == [
        ("abc1", "logo.png", None, None),
        ("abc1", "src/A.java", 3, 1),
        ("abc2", "a/{x => y}/C.java", 0, 4),
        ("abc2", "src/A.java", 10, 0),
        ("abc4", "CHANGES.md", 7, 7),
    ]
    assert {row["repository"] for row in changes.collect()} == {"o/r"}
    churn = dicts(history.file_churn(changes), "file")
    assert (churn["src/A.java"]["commits"], churn["src/A.java"]["lines_added"]) == (2, 13)
    assert (churn["logo.png"]["commits"], churn["logo.png"]["lines_added"]) == (1, 0)


@pytest.mark.parametrize("split_bytes", [64, 97, 257, 1000])
def test_change_log_splits_anywhere(spark, tmp_path, split_bytes):
    commits = [(f"{i:040x}", [f"d{i % 7}/F{j}.java" for j in range(i % 4)]) for i in range(300)]
    file = tmp_path / "o__r.log"
    with file.open("w") as out:
        for sha, files in commits:
            out.write(f"C{sha}\n")
            if files:
                out.write("\n")
            for name in files:
                out.write(f"1\t2\t{name}\n")
    settings = {
        "spark.sql.files.maxPartitionBytes": str(split_bytes),
        "spark.sql.files.openCostInBytes": "1",
        "spark.sql.files.minPartitionNum": "1",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        changes = history_text.scan_change_log(spark, str(file))
        found = changes.orderBy("log_seq", "file").select("sha", "file").collect()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert [tuple(row) for row in found] == [(sha, name) for sha, fs in commits for name in fs]


def test_author_summary(spark, tmp_path):
    (tmp_path / "o__r.txt").write_text(
        "    12\tAnn Lee <ann@x.org>\n     3\tNA <na@x>\n  1  no mail\n\n 2\tB <a> C <>\n"
    )
    found = history_text.scan_author_summary(spark, str(tmp_path)).orderBy("commits").collect()
    assert [tuple(row) for row in found] == [
        ("o/r", "B", "a> C <", 2), ("o/r", "NA", "na@x", 3), ("o/r", "Ann Lee", "ann@x.org", 12),
    ]


def test_line_count_reports_and_fallback(rows):
    reports = rows(
        "repository string, value string",
        ("a/b", '{"Java": {"nFiles": 2, "code": 9}, "SUM": {"nFiles": 5, "blank": 1, "code": 30}}'),
        ("c/d", "{}"),
        ("e/f", "{broken"),
        ("g/h", None),
    )
    reported = trees.parse_line_counts(reports)
    found = dicts(reported, "repository")
    assert tuple(found["a/b"].values()) == ("a/b", 5, 1, 0, 30, 2, 9, 0, 0)
    assert tuple(found["c/d"].values()) == ("c/d", 0, 0, 0, 0, 0, 0, 0, 0)
    assert set(found) == {"a/b", "c/d"}
    counted = rows(
        ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SCHEMAS["loc"].fields),
        ("a/b", *[1] * 8),
        ("e/f", *[2] * 8),
    )
    chosen = dicts(trees.first_available(reported, counted), "repository")
    assert {key: row["code"] for key, row in chosen.items()} == {"a/b": 30, "c/d": 0, "e/f": 2}


def test_source_tree(spark, tmp_path):
    root = tmp_path / "repos"
    for path, content in {
        "o__r/src/A.java": b"class A {}\n",
        "o__r/deep/er/B.java": b"caf\xff\xc3\xa9",
        "o__r/readme.md": b"x",
        "p__q/C.java": b"\n",
    }.items():
        file = root / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(content)
    found = trees.scan_source_files(spark, str(root)).orderBy("repository", "file").collect()
    assert [tuple(row) for row in found] == [
        ("o/r", "deep/er/B.java", "caf\xe9"),
        ("o/r", "src/A.java", "class A {}\n"),
        ("p/q", "C.java", "\n"),
    ]


def test_git_folders_hold_no_sources(rows):
    files = rows(
        "path string, content binary",
        ("file:/d/repos/o__r/.git/hooks/X.java", bytearray(b"x")),
        ("hdfs://host/d/repos/o__r/a/X.java", bytearray(b"x")),
        ("file:///d/repos/o__r/X.java", bytearray(b"x")),
        ("/elsewhere/o__r/X.java", bytearray(b"x")),
    )
    for root in ("/d/repos", "file:/d/repos/", "hdfs://host/d/repos"):
        found = trees.parse_source_files(files, root).collect()
        assert sorted(row["file"] for row in found) == ["X.java", "a/X.java"]


def test_repository_discovery(rows):
    listing = rows(
        "path string",
        ("/d/repos/z__r/.git/HEAD",), ("/d/repos/Z__r/.git",), ("/d/repos/z__r/.git/x",),
        ("/d/repos/n__g/src/.git/HEAD",), ("/d/repos/m__g/.gitignore",), ("/d/.git/HEAD",),
    )
    found = trees.discover_repositories(listing, "/d/repos/").collect()
    assert [row["repository"] for row in found] == ["Z/r", "z/r"]


def test_landing_without_data_keeps_the_header(spark, tmp_path):
    path = str(tmp_path / "complexity")
    sinks.write_nothing(spark, path, "complexity")
    frame = landed.scan_csv(spark, path, "complexity")
    assert frame.isEmpty() and frame.columns == columns("complexity")
    sinks.write_parquet(landed.empty_table(spark, "structure"), path + "2", "structure")
    assert spark.read.parquet(path + "2").columns == columns("structure")


def test_selected_names_are_written_in_order(spark, rows, tmp_path):
    path = str(tmp_path / "selected")
    selected = rows("full_name string, seq long", ("b/x", 1), ("a/y", 2), ("c/z", 3))
    sinks.write_repository_list(selected.orderBy("seq").limit(10), path)
    parts = list((tmp_path / "selected").glob("part-*"))
    assert len(parts) == 1 and parts[0].read_text() == "b/x\na/y\nc/z\n"


def test_consolidation_replaces_tables_and_strips_keys(spark, rows):
    spark.sql("create database if not exists analytics")
    schema = "repository string, developer string, email string, commits long"
    for name in ("first", "second"):
        tables = {
            "developers": rows(schema, (" a/b \t", name, "e", 1)),
            "unlisted": rows("x int", (1,)),
        }
        assert sinks.consolidate(spark, tables, "analytics") == ["analytics.developers"]
    found = spark.sql("select * from analytics.developers").collect()
    assert [tuple(row) for row in found] == [("a/b", "second", "e", 1)]


def test_keys_are_stripped_nowhere_else(spark, tmp_path):
    file = tmp_path / "developers.csv"
    file.write_text("repository,developer,email,commits\n a/b ,x,y,1\n")
    row = landed.scan_csv(spark, str(file), "developers").first()
    assert row["repository"] == " a/b "


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_scans_push_filters_and_prune_columns(spark, tmp_path):
    path = str(tmp_path / "commit")
    sinks.write_parquet(landed.empty_table(spark, "commit"), path, "commit")
    commits = landed.scan_parquet(spark, path, "commit")
    plan = history.developer_commits(commits)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(parent_count), LessThan(parent_count,2)]" in plan
    assert "ReadSchema: struct<repository:string,parent_count:int,author_name:string" in plan
    assert "committed_at_iso" not in plan.split("ReadSchema")[1].split("\n")[0]
    sources = landed.scan_parquet(spark, path + "_none", "source_file")
    assert sources.isEmpty()
    sinks.write_parquet(sources, path + "_source", "source_file")
    sources = landed.scan_parquet(spark, path + "_source", "source_file")
    lines = code.line_classes(code.source_profile(sources))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<repository:string,text:string>" in lines
    assert "Test" not in lines.split("== Physical Plan ==")[1]
    ends = history.first_and_last_commit(commits)._jdf.queryExecution().toString()
    assert "Or(And(EqualTo(on_head,true),EqualTo(parent_count,0)),EqualTo(is_head,true))" in ends


def test_a_response_with_too_many_results_is_an_error(spark, tmp_path, monkeypatch):
    (tmp_path / "r.json").write_text('{"items": [{"full_name": "a/b"}, {"full_name": "a/c"}]}\n')
    rows = hosting.scan_repository_json(spark, str(tmp_path), "seq").orderBy("seq").collect()
    assert [row.full_name for row in rows] == ["a/b", "a/c"]
    monkeypatch.setattr(hosting, "RESULTS_PER_RESPONSE", 1)
    with pytest.raises(Exception, match="too many results"):
        hosting.scan_repository_json(spark, str(tmp_path), "seq").collect()
