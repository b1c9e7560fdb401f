"""Trees listed and read on executors, and the replacement of single repositories."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from codestrata.sinks.tables import replace_repositories, scan_replaced
from codestrata.sources import listing, trees

FILES = {
    "o__r/src/A.java": b"class A {}", "o__r/.hidden/B.java": b"class B {}",
    "o__r/_C.java": b"class C {}", "o__r/Empty.java": b"", "o__r/a b%20c#.java": "é".encode(),
    "o__r/.git/HEAD": b"ref", "o__r/.git/x/D.java": b"no", "o__r/read.me": b"no",
    "o__s/deep/er/and/er/E.java": b"bad \xc3\xff bytes", "top.java": b"no repository",
    "none__git/src/.git/HEAD": b"", "o__s/.git": b"gitdir: elsewhere",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, content in FILES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    (root / "empty__folder").mkdir()
    return str(root)


@pytest.mark.parametrize("prefix", ["", "file:", "file://"])
def test_listing(spark, root, prefix):
    rows = listing.list_tree(spark, prefix + root + "/").collect()
    found = {row.path.removeprefix(prefix + root + "/"): row for row in rows}
    assert len(found) == len(rows)
    walked = set()
    for folder, folders, files in os.walk(root):
        inside = os.path.relpath(folder, root)
        if ".git" in inside.split("/"):
            continue
        walked |= {os.path.normpath(f"{inside}/{name}") for name in folders + files}
    assert set(found) == walked
    assert found["o__r/src"].is_dir and found["o__r/src"].length is None
    assert found["o__r/src/A.java"].length == 10 and found["o__r/Empty.java"].length == 0


@pytest.mark.parametrize("prefix", ["", "file:"])
def test_sources_of_a_tree(spark, root, prefix):
    found = listing.scan_tree_sources(spark, prefix + root).collect()
    assert {(r.repository, r.file): r.text for r in found} == {
        ("o/r", "src/A.java"): "class A {}", ("o/r", ".hidden/B.java"): "class B {}",
        ("o/r", "_C.java"): "class C {}", ("o/r", "Empty.java"): "",
        ("o/r", "a b%20c#.java"): "é", ("o/s", "deep/er/and/er/E.java"): "bad  bytes",
    }


def test_repositories_of_a_tree(spark, root):
    found = trees.discover_repositories(listing.list_tree(spark, root), root).collect()
    assert [row.repository for row in found] == ["o/r", "o/s"]


def test_odd_roots(spark, tmp_path, monkeypatch):
    assert listing.list_tree(spark, str(tmp_path)).collect() == []
    assert listing.scan_tree_sources(spark, str(tmp_path)).collect() == []
    with pytest.raises(Exception, match="[Nn]ot ?[Ff]ound|does not exist|No such"):
        listing.list_tree(spark, str(tmp_path / "gone")).collect()
    (tmp_path / "loop").symlink_to(tmp_path)
    monkeypatch.setattr(listing, "DEEPEST", 5)
    with pytest.raises(ValueError, match="levels"):
        listing.list_tree(spark, str(tmp_path))


def test_files_are_dealt_by_their_bytes(spark, tmp_path, monkeypatch):
    for i in range(60):
        (tmp_path / f"{i}.java").write_bytes(b"x" * 1000)
    files = listing.list_tree(spark, str(tmp_path))
    monkeypatch.setattr(listing, "TASK_BYTES", 10_000)
    monkeypatch.setattr(listing, "BATCH_BYTES", 2_500)
    read = listing.read_files(files, str(tmp_path))
    assert read.rdd.getNumPartitions() == 6
    assert read.agg(F.sum(F.length("content"))).first()[0] == 60_000


STRUCTURE = (
    "repository string, file string, type_name string, kind string, is_abstract boolean,"
    " is_interface boolean, methods int, attributes int, extends string, implements string"
)


def types(spark, *rows):
    return spark.createDataFrame(
        [(r, f, "T", "class", False, False, n, 0, "", None) for r, f, n in rows], STRUCTURE)


def test_a_rerun_replaces_its_repositories_only(spark, tmp_path):
    path = str(tmp_path / "structure")
    replace_repositories(types(spark, ("a/b", "f", 1), ("a/b", "g", 1), ("7", "f", 1),
                               ("ü %=:", "f", 1)), path, "structure")
    kept = {p: p.read_bytes() for p in (tmp_path / "structure").glob("repository=7/*.parquet")}
    replace_repositories(types(spark, ("a/b", "h", 2), ("new", "f", 3)), path, "structure")
    replace_repositories(types(spark), path, "structure")
    found = scan_replaced(spark, path, "structure")
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema).replace(
        "bigint", "long") == STRUCTURE
    assert sorted((r.repository, r.file, r.methods) for r in found.collect()) == [
        ("7", "f", 1), ("a/b", "h", 2), ("new", "f", 3), ("ü %=:", "f", 1)]
    assert kept and all(p.read_bytes() == data for p, data in kept.items())
