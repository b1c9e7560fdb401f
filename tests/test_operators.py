"""Operators on literal rows, and against brute force where keys are skewed."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from conftest import dicts
from pyspark.sql import functions as F

from codestrata.operators import candidates, code, history, people, pull_requests
from codestrata.operators.ranking import first_per_key, top_per_key
from codestrata.plans import hotspots, indicators, report
from codestrata.schemas import SCHEMAS, columns
from codestrata.sources.landed import empty_table

COMMIT = (
    "repository string, sha string, parent_count int, author_name string, author_email string,"
    "committed_at_iso string, on_head boolean, is_head boolean"
)
COMMITS = [
    # Two roots on the head: the older instant wins although its text sorts last.
    ("a/b", "1", 0, "ann", "a@x", "2020-01-02T01:00:00+09:00", True, False),
    ("a/b", "2", 0, "ann", "a@x", "2020-01-01T20:00:00+00:00", True, False),
    ("a/b", "0", 0, "bob", "b@x", "2019-01-01T00:00:00+00:00", False, False),
    ("a/b", "3", 1, "bob", "b@x", "2020-01-02T01:30:00+09:00", True, False),
    ("a/b", "4", 2, "bob", "b@x", "2020-01-05T00:00:00-05:00", True, False),
    ("a/b", "5", 1, "NA", "n@x", "2020-01-04T10:00:00-05:00", True, True),
    ("a/b", "6", 1, "NA", "n@y", "2020-02-04T10:00:00-05:00", False, False),
    ("c/d", "7", 1, "x", "x@x", "2020-01-01T00:00:00Z", False, False),
]


def test_commit_summary(rows):
    found = dicts(history.commit_summary(rows(COMMIT, *COMMITS)), "repository")
    assert tuple(found["a/b"].values()) == (
        "a/b", 5, "2020-01-02T01:00:00+09:00", "2020-01-04T10:00:00-05:00", 2, 4,
    )
    assert tuple(found["c/d"].values()) == ("c/d", 0, "", "", 0, 0)


def test_published_schemas(rows, spark):
    commits = rows(COMMIT, *COMMITS)
    changes = empty_table(spark, "file_change")
    profile = code.source_profile(empty_table(spark, "source_file"))
    published = {
        "commits": history.commit_summary(commits),
        "developers": history.developer_commits(commits),
        "files": history.changed_files(history.file_churn(changes)),
        "pull_requests": pull_requests.pull_request_facts(empty_table(spark, "raw_pull_request")),
        "loc": code.line_classes(profile),
        "tests": code.tests_summary(profile),
    }
    for table, frame in published.items():
        kinds = [(f.name, f.dataType) for f in frame.schema.fields]
        assert kinds == [(f.name, f.dataType) for f in SCHEMAS[table].fields], table


def test_authors_leave_out_merges_and_keep_all_branches(rows):
    found = history.developer_commits(rows(COMMIT, *COMMITS)).collect()
    assert {tuple(row) for row in found} == {
        ("a/b", "ann", "a@x", 2), ("a/b", "bob", "b@x", 2), ("a/b", "NA", "n@x", 1),
        ("a/b", "NA", "n@y", 1), ("c/d", "x", "x@x", 1),
    }


CHANGE = "repository string, sha string, log_seq long, file string, added long, removed long"


def test_file_churn_counts_binary_changes(rows):
    changes = rows(
        CHANGE,
        ("a/b", "1", 5, "logo.png", None, None),
        ("a/b", "2", 3, "logo.png", None, None),
        ("a/b", "2", 3, "a/{x => y}/C.java", 1, 0),
        ("c/d", "9", 1, "a/{x => y}/C.java", 2, 2),
    )
    found = {(r["repository"], r["file"]): tuple(r)[2:] for r in history.file_churn(changes).collect()}
    assert found == {
        ("a/b", "logo.png"): (2, 0, 0, 3),
        ("a/b", "a/{x => y}/C.java"): (1, 1, 0, 3),
        ("c/d", "a/{x => y}/C.java"): (1, 2, 2, 1),
    }


def test_file_limit_breaks_ties_by_first_appearance(rows):
    churn = rows(
        "repository string, file string, commits long, lines_added long, lines_removed long,"
        "first_seen long",
        ("a", "z", 2, 0, 0, 1), ("a", "y", 2, 0, 0, 3), ("a", "x", 2, 0, 0, 3),
        ("a", "w", 1, 0, 0, 0), ("b", "w", 1, 0, 0, 0),
    )
    found = history.most_changed_files(churn, 2).collect()
    assert {(r["repository"], r["file"]) for r in found} == {("a", "z"), ("a", "x"), ("b", "w")}


@pytest.mark.parametrize("n", [1, 5, 40])
def test_top_per_key_with_a_hot_key(spark, n):
    source = random.Random(n)
    data = [("hot", i, source.randrange(50)) for i in range(4000)]
    data += [(f"k{source.randrange(400)}", 10_000 + i, source.randrange(50)) for i in range(4000)]
    frame = spark.createDataFrame(data, "key string, id long, value long").repartition(16)
    order = [F.desc("value"), F.asc("id")]
    found = defaultdict(list)
    for row in top_per_key(frame, ["key"], order, n, ["id"]).orderBy("key", "rank").collect():
        assert row["rank"] == len(found[row["key"]]) + 1
        found[row["key"]].append(row["id"])
    groups = defaultdict(list)
    for key, number, value in data:
        groups[key].append((-value, number))
    assert found == {k: [number for _, number in sorted(v)[:n]] for k, v in groups.items()}


def test_top_per_key_limits_before_each_shuffle(spark):
    frame = spark.range(1000).select((F.col("id") % 3).alias("key"), "id")
    plan = top_per_key(frame, ["key"], [F.desc("id")], 5, ["id"])._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert physical.count("WindowGroupLimit") == 4
    plain = top_per_key(frame, ["key"], [F.desc("id")], 1)._jdf.queryExecution().toString()
    assert plain.split("== Physical Plan ==")[1].count("WindowGroupLimit") == 2


def test_first_per_key(rows):
    landed = rows("repository string, stars long, ingest_seq long", ("a", 9, 7), ("a", 1, 3), ("b", 5, 9))
    assert {tuple(r) for r in first_per_key(landed, "repository").collect()} == {("a", 1), ("b", 5)}
    plain = rows("repository string, stars long", ("a", 9), ("a", 1))
    assert [tuple(r) for r in first_per_key(plain, "repository").collect()] == [("a", 1)]


DEVELOPER = "repository string, developer string, email string, commits long"


@pytest.mark.parametrize("n", [1, 5])
def test_contribution_share_with_a_hot_key(spark, n):
    source = random.Random(n)
    data = [("hot", f"d{i}", "e", int(source.paretovariate(0.8))) for i in range(3000)]
    data += [(f"r{i % 300}", f"d{i}", "e", source.randrange(1, 30)) for i in range(3000)]
    frame = spark.createDataFrame(data, DEVELOPER).repartition(8)
    groups = defaultdict(list)
    for repository, _, _, commits in data:
        groups[repository].append(commits)
    expected = {
        key: (len(v), float(round(10000 * sum(sorted(v)[-n:]) / sum(v)) / 100))
        for key, v in groups.items()
    }
    found = people.contribution_share(frame, n, "share").collect()
    assert {r["repository"]: r["contributors"] for r in found} == {
        key: count for key, (count, _) in expected.items()
    }
    for row in found:
        assert row["share"] == pytest.approx(expected[row["repository"]][1], abs=0.0051)
        assert 0 <= row["share"] <= 100


def test_share_ties_zero_and_risk_limits(rows):
    developers = rows(
        DEVELOPER,
        *[("tied", f"d{i}", "e", 2) for i in range(10)],
        ("none", "d", "e", 0),
        *[("high", f"d{i}", "e", 16) for i in range(5)], *[("high", f"x{i}", "e", 1) for i in range(20)],
        *[("medium", f"d{i}", "e", 12) for i in range(5)], *[("medium", f"x{i}", "e", 1) for i in range(40)],
    )
    shares = people.contribution_share(developers)
    risk = people.concentration_risk(F.col("top5_commit_share_pct")).alias("risk")
    found = dicts(shares.select("*", risk), "repository")
    assert {k: (v["top5_commit_share_pct"], v["risk"]) for k, v in found.items()} == {
        "tied": (50.0, "low"), "none": (0.0, "low"), "high": (80.0, "high"), "medium": (60.0, "medium"),
    }


RAW = (
    "repository string, number long, state string, created_at string, closed_at string,"
    "merged_at string, author string, commits long"
)


def test_pull_request_facts(rows):
    raw = rows(
        RAW,
        ("a", 1, "closed", "2026-01-01T00:00:00Z", "2026-01-01T00:00:18Z", "", "x", 1),
        ("a", 2, "closed", "2026-01-02T00:00:00Z", "", "2026-01-03T12:00:00Z", "x", 2),
        ("a", 3, "open", "2026-01-03T00:00:00Z", None, None, "", 3),
        ("a", 4, "closed", "2026-01-03T00:00:00Z", "2026-01-02T00:00:00Z", "", "", None),
        ("a", 5, "closed", "bad", "2026-01-02T00:00:00Z", "2026-01-02T00:00:00Z", "", 9),
        ("b", 1, "open", "", "", "", "", 1),
    )
    found = dicts(pull_requests.pull_request_facts(raw, newest=4, counted=3).filter("repository = 'a'"), "number")
    assert set(found) == {1, 2, 3, 4}
    assert {n: r["state"] for n, r in found.items()} == {1: "closed", 2: "merged", 3: "open", 4: "closed"}
    # 18 s are exactly 0.005 h in decimal, and slightly more as a double.
    assert {n: r["hours_to_close"] for n, r in found.items()} == {1: 0.01, 2: 36.0, 3: None, 4: -24.0}
    assert {n: r["commits"] for n, r in found.items()} == {1: None, 2: 2, 3: 3, 4: None}


def test_pull_request_health(rows):
    facts = rows(
        "repository string, state string, commits string, hours_to_close string",
        ("a", "open", "3", ""), ("a", "merged", "4", "1.25"), ("a", "closed", "x", "1.26"),
        ("a", "draft", None, None), ("b", "open", None, None),
    )
    found = {r["repository"]: tuple(r)[1:] for r in pull_requests.pull_request_health(facts).collect()}
    assert found["a"][:3] == (1, 2, 3.5) and found["a"][3] in (1.25, 1.26)
    assert found["b"] == (1, 0, None, None)


def test_structure_summary_counts_stated_parents(rows):
    types = rows(
        "repository string, kind string, methods int, extends string",
        ("a", "class", 3, "B"), ("a", "class", 2, ""), ("a", "interface", 1, None),
        ("a", "enum", None, "C;D"),
    )
    assert tuple(code.structure_summary(types).first()) == ("a", 2, 1, 6, 2)


def test_source_profile_counts_every_file(rows):
    sources = rows(
        "repository string, file string, text string",
        ("a", "xsrc/test/X.java", "import org.junit.Test;\n@Test @Test\n"),
        ("a", "src/test/X.java", "import org.junit.Test;\n@Test @Test\n\n * @Test"),
        ("a", "YTests.java", "spock.lang"), ("a", "Z.java", "org.mockito\n@Test\n// x\n"),
        ("a", "Empty.java", ""), ("a", "EmptyTest.java", ""), ("a", "BrokenTest.java", None),
        ("b", "Only.java", None),
    )
    profile = code.source_profile(sources)
    loc = dicts(code.line_classes(profile), "repository")
    assert tuple(loc["a"].values())[1:5] == (7, 1, 2, 7)
    assert tuple(loc["b"].values())[1:] == (1, 0, 0, 0) * 2
    tests = dicts(code.tests_summary(profile), "repository")
    assert tuple(tests["a"].values())[1:] == (3, 3, 5, 4, 0.8, "junit;spock")
    assert tuple(tests["b"].values())[1:] == (0, 0, 0, 0, 0.0, "")


def test_type_declarations(rows):
    text = """
    // class Commented {
    public abstract class A<T extends Map<K, List<V>>> extends Base<T, U> implements X, Y<Z> {
      private static final class Inner extends p.q.Outer {}
      enum Color implements Paint { RED }
      String s = "class Quoted {";
    }
    interface I extends J, K<L> {}
    @interface Mark {}
    class
      Late
      extends Early {
    Class<?> notOne; classy {
    """
    found = code.type_declarations(rows("repository string, file string, text string", ("r", "f", text)))
    got = [tuple(r)[3:] for r in found.orderBy("position").collect()]
    assert got == [
        ("A", "class", True, False, "Base", "X;Y"),
        ("Inner", "class", False, False, "p.q.Outer", ""),
        ("Color", "enum", False, False, "", "Paint"),
        ("I", "interface", False, True, "J;K", ""),
        ("Mark", "class", False, False, "", ""),
        ("Late", "class", False, False, "Early", ""),
    ]


REPOSITORY = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SCHEMAS["repositories"].fields)
AS_OF = "2026-06-01T00:00:00Z"


def repository(name, seq, *, stars=6000, forks=2000, language="Java", pushed="2026-05-01T00:00:00Z", archived=False):
    return (name, "u", stars, forks, 0, language, "", pushed, archived, "", seq)


def test_validity_and_first_valid_duplicate(rows):
    found = rows(
        REPOSITORY + ", seq long",
        repository("a/b", 1, archived=True), repository("a/b", 3, stars=1), repository("a/b", 2, stars=2),
        repository("", 4), repository(None, 5), repository("c/d", 6, language=None),
        repository("e/f", 7, language="JAVA", archived=None), repository("g/h", 8, pushed=""),
        repository("i/j", 9, pushed="2025-05-31T00:00:01Z"), repository("k/l", 10, pushed="2025-05-31T00:00:00Z"),
        repository("m/n", 11, pushed="2027-01-01T00:00:00Z"), repository("o/p", 12, pushed="soon"),
    )
    kept = {(r["full_name"], r["seq"]) for r in candidates.valid(found, AS_OF).collect()}
    assert kept == {("a/b", 2), ("e/f", 7), ("i/j", 9), ("m/n", 11)}


def test_search_orders_by_stars(rows):
    listed = rows(
        REPOSITORY + ", seq long",
        repository("low", 1, stars=5000), repository("few", 2, forks=1000), repository("b", 3, stars=7000),
        repository("a", 4, stars=7000), repository("top", 5, stars=9000), repository("k", 6, language="Kotlin"),
    )
    found = candidates.search(listed, limit=2).orderBy("seq").collect()
    assert [(r["full_name"], r["seq"]) for r in found] == [("top", 1), ("a", 2)]


@pytest.mark.parametrize(
    ("found", "fallback", "expected"),
    [
        (3, "fresh", ["r0", "r1", "r2"]),
        (2, "fresh", ["s0", "s1", "s2"]),
        (0, "stale", ["s0", "s1", "s2"]),
    ],
)
def test_selection_falls_back_as_a_whole(rows, found, fallback, expected):
    schema = REPOSITORY + ", seq long"
    searched = rows(schema, *[repository(f"r{i}", i) for i in range(found)])
    pushed = "2026-05-01T00:00:00Z" if fallback == "fresh" else "2001-05-01T00:00:00Z"
    spare = rows(schema, *[repository(f"s{i}", i, pushed=pushed) for i in range(5)])
    chosen = candidates.select_repositories(searched, spare, AS_OF, n=3).collect()
    assert [row["full_name"] for row in chosen] == expected


def test_curated_fallback(spark):
    listed = candidates.fallback_rows(spark)
    assert listed.columns == [*columns("repositories"), "seq"]
    empty = listed.limit(0)
    chosen = candidates.select_repositories(empty, listed, AS_OF).collect()
    assert [r["full_name"] for r in chosen] == list(candidates.FALLBACK_REPOSITORIES)


def test_hotspots(rows):
    files = rows(
        "repository string, file string, commits long, lines_added long, lines_removed long",
        ("a", "x", 10, 0, 0), ("a", "y", 3, 0, 0), ("a", "/z", 100, 0, 0), ("b", "x", 10, 0, 0),
    )
    methods = rows(
        "repository string, file string, ccn int",
        ("a", "x", 1), ("a", "x", 2), ("a", "y", 9), ("a", "z", 50), ("b", "x", 1), ("b", "x", 2),
    )
    scores = hotspots.hotspot_scores(files, methods)
    top = [tuple(r) for r in hotspots.top_hotspots(scores, 3).collect()]
    assert top == [("a", "y", 3, 9.0, 27.0), ("a", "x", 10, 1.5, 15.0), ("b", "x", 10, 1.5, 15.0)]
    assert [tuple(r) for r in hotspots.reported_hotspots(scores, 1).collect()] == top[:1]
    zero = scores.filter("file = '/z'").first()
    assert (zero["avg_ccn"], zero["hotspot_score"]) == (0.0, 0.0)


def empty_tables(spark):
    names = ("repositories", "commits", "developers", "loc", "tests", "structure", "complexity",
             "pull_requests")
    return {name: empty_table(spark, name) for name in names}


def test_indicator_defaults_and_keys(spark, rows):
    tables = empty_tables(spark)
    facts = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SCHEMAS["pull_requests"].fields)
    tables["loc"] = rows("repository string, files long, code long", ("only_loc", 1, 5))
    tables["structure"] = rows(
        "repository string, kind string, methods int, extends string", ("Typed", "class", 8, "X")
    )
    tables["tests"] = rows("repository string, test_methods long", ("Typed", 3))
    tables["pull_requests"] = rows(
        facts,
        ("Typed", 1, "open", "", "", "", None, None, ""), ("unknown", 1, "open", "", "", "", 1.0, 1, ""),
    )
    mart = indicators.in_key_order(indicators.quality_indicators(tables))
    assert [(f.name, f.dataType) for f in mart.schema.fields] == [
        (f.name, f.dataType) for f in SCHEMAS["quality_indicators"].fields
    ]
    found = mart.collect()
    assert [row["repository"] for row in found] == ["Typed", "only_loc"]
    typed, plain = found
    assert (typed["testability"], typed["pr_open"], typed["activity_score"]) == (0.375, 1, 1)
    assert (typed["avg_commits_per_pr"], typed["avg_pr_close_hours"]) == (None, None)
    assert (plain["avg_commits_per_pr"], plain["avg_pr_close_hours"]) == (0.0, 0.0)
    assert (plain["total_loc"], plain["concentration_risk"], plain["max_ccn"]) == (5, "low", 0)


def test_known_repositories(spark, rows):
    named = rows("full_name string, x int", ("a", 1), ("b", 1))
    other = rows("repository string", ("b",), (" b",), (None,))
    keys = {r[0] for r in indicators.known_repositories(named, other).collect()}
    assert keys == {"a", "b", " b"}


def test_mart_has_no_joins(spark):
    plan = indicators.quality_indicators(empty_tables(spark))._jdf.queryExecution()
    assert "Join" not in plan.optimizedPlan().toString()


def test_report_tables_with_missing_columns(rows):
    mart = rows("repository string, stars long, activity_score long", ("a/x", 1, 5), ("b/y", 2, 5), ("c/z", 3, 9))
    ranked = report.activity_ranking(mart)
    assert ranked.columns == ["repository", "stars", "activity_score"]
    assert [r["repository"] for r in ranked.collect()] == ["c/z", "a/x", "b/y"]
    assert report.modularity_view(mart) is None and report.concentration_ranking(mart) is None
    series = [tuple(r) for r in report.metric_series(mart).collect()]
    assert series == [
        ("activity_score", "a/x", "x", 5.0), ("activity_score", "b/y", "y", 5.0),
        ("activity_score", "c/z", "z", 9.0),
        ("stars", "a/x", "x", 1.0), ("stars", "b/y", "y", 2.0), ("stars", "c/z", "z", 3.0),
    ]
    assert report.scope_size(mart).first()[0] == 3


@pytest.mark.parametrize("partitions", [1, 8])
def test_results_do_not_depend_on_partitioning(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    source = random.Random(5)
    data = [
        (f"r{source.randrange(3)}", str(i), i // 3, f"f{source.randrange(40)}", i % 7, i % 5)
        for i in range(3000)
    ]
    try:
        churn = history.file_churn(spark.createDataFrame(data, CHANGE).repartition(partitions))
        kept = {(r["repository"], r["file"]) for r in history.most_changed_files(churn, 10).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    counts, first = Counter(), {}
    for repository, _, sequence, file, _, _ in data:
        counts[repository, file] += 1
        first.setdefault((repository, file), sequence)
    expected = set()
    for repository in ("r0", "r1", "r2"):
        own = [key for key in counts if key[0] == repository]
        expected |= set(sorted(own, key=lambda k: (-counts[k], first[k], k[1]))[:10])
    assert kept == expected
