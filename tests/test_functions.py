"""Column functions against the Python behaviour they must reproduce."""

from __future__ import annotations

import random
import re
from datetime import UTC, datetime

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codestrata.functions import instants, names, numeric, text
from codestrata.operators import code
from codestrata.sources import trees


def evaluate(spark, expression, values, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [row[1] for row in frame.select("i", expression(F.col("v"))).orderBy("i").collect()]


@pytest.mark.parametrize("digits", [2, 4])
def test_round_exact_is_scalar_round(spark, digits):
    source = random.Random(7)
    ratios = [source.randrange(1, 9000) / source.randrange(1, 9000) for _ in range(20000)]
    hours = [s / 1e6 / 3600 for s in (source.randrange(-10**12, 10**12) for _ in range(5000))]
    ties = [(2 * k + 1) / (2 * 10**digits) for k in range(-5000, 5000)]
    seconds = [(18 + 36 * k) / 3600 for k in range(5000)]
    binary = [k / 64 for k in range(-2000, 2000)]
    values = ratios + hours + ties + seconds + binary + [0.0, 2.675, 1.005, 1e9 + 0.125]
    result = evaluate(spark, lambda v: numeric.round_exact(v, digits), values, "double")
    assert result == [round(v, digits) for v in values]


def test_round_scaled_is_array_round(spark):
    source = random.Random(3)
    values = [source.randrange(0, 10**6) / source.randrange(1, 400) for _ in range(20000)]
    values += [(2 * k + 1) / 200 for k in range(5000)]
    result = evaluate(spark, lambda v: numeric.round_scaled(v, 2), values, "double")
    assert result == [float(x) for x in np.round(np.array(values), 2)]


def test_ratio_of_nothing_is_zero(spark):
    frame = spark.createDataFrame([(1, 0), (1, 3), (0, 5)], "a long, b long")
    ratio = numeric.ratio_or_zero(F.col("a"), F.col("b"), 4)
    assert [row[0] for row in frame.select(ratio).collect()] == [0.0, 0.3333, 0.0]


def test_decimal_mean_does_not_depend_on_order(spark):
    values = [(x / 100,) for x in random.Random(1).sample(range(10**7), 999)] + [(None,)]
    forward = spark.createDataFrame(values, "v double").repartition(7)
    backward = spark.createDataFrame(values[::-1], "v double").coalesce(1)
    mean = numeric.decimal_mean(F.col("v"))
    left, right = (frame.select(mean).first()[0] for frame in (forward, backward))
    assert left == right == pytest.approx(np.mean([v for (v,) in values[:-1]]))
    assert spark.createDataFrame([(None,)], "v double").select(mean).first()[0] is None


def test_counts_are_digits_only(spark):
    values = ["12", "-", "", "1.5", " 7", None, "007", "9" * 30]
    assert evaluate(spark, numeric.coerce_count, values) == [
        12, None, None, None, None, None, 7, None,
    ]


def test_numbers_are_coerced(spark):
    values = ["12", "1.5", "x", "", None, " 7 ", "NaN", "inf", "-3"]
    assert evaluate(spark, numeric.coerce_number, values) == [
        12.0, 1.5, None, None, None, 7.0, None, None, -3.0,
    ]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_instants_do_not_depend_on_the_session_zone(spark, zone):
    values = [
        "2018-10-06T19:38:31+08:00", "2026-05-03T00:58:42Z", "2020-01-01T00:00:00",
        "2020-01-01 10:11:12.5", "2019-02-28T22:27:49-05:00", "2020-01-01",
        "2020-01-01T10:11:12+0530", "2020-01-01T10:11:12-03", "2020-01-01T10:11:12.123456+05:30",
        "2020-01-01T10:11", "2020-01-01T10:11Z",
    ]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        micros = evaluate(spark, lambda v: F.unix_micros(instants.iso_instant(v)), values)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)

    def expected(value):
        parsed = datetime.fromisoformat(value.replace("Z", "+00:00"))
        aware = parsed if parsed.tzinfo else parsed.replace(tzinfo=UTC)
        return round(aware.timestamp() * 1_000_000)

    assert micros == [expected(value) for value in values]


def test_unparsable_instants_are_null(spark):
    values = ["", "soon", None, "2018", "2018-13-40T00:00:00Z", "12:00", "T12:00Z",
              "2018-10", "20181006T193831Z", "2018-10-06Tnoon"]
    assert evaluate(spark, instants.iso_instant, values) == [None] * len(values)


def test_elapsed_days_round_to_the_past(spark):
    pairs = [
        ("2020-01-01T00:00:00Z", "2020-01-02T23:59:59Z", 1),
        ("2020-01-02T00:00:00Z", "2020-01-01T23:59:59Z", -1),
        # The local dates differ by one more day than has elapsed.
        ("2018-10-06T19:38:31+08:00", "2026-05-03T08:58:41+08:00", 2765),
        ("2019-02-28T22:27:49-05:00", "2026-05-29T11:08:59-04:00", 2646),
    ]
    frame = spark.createDataFrame(pairs, "a string, b string, days int")
    found = instants.elapsed_days(
        instants.iso_instant(F.col("a")), instants.iso_instant(F.col("b"))
    )
    assert frame.filter(found != F.col("days")).count() == 0


def test_local_day_is_as_written(spark):
    assert evaluate(spark, instants.local_day, ["2020-01-01T23:00:00-05:00"]) == ["2020-01-01"]


def test_key_codec(spark):
    keys = ["a/b", "a__b", "x/y__z"]
    assert evaluate(spark, names.folder_of, keys) == ["a__b", "a__b", "x__y__z"]
    assert evaluate(spark, names.repository_of, ["a__b", "a_b", "a__b__c"]) == [
        "a/b", "a_b", "a/b/c",
    ]
    assert evaluate(spark, names.short_name, ["a/b", "b", "a/b/c", "a/"]) == ["b", "b", "c", ""]


def test_strip_removes_all_whitespace(spark):
    values = ["  a b ", "\u3000\x1fx\x85\n", "", "\u2028", "\ufeffkept\u200b"]
    assert evaluate(spark, names.strip, values) == [v.strip() for v in values]


def test_whitespace_is_what_strip_removes():
    every = {chr(i) for i in range(0x110000)}
    assert set(text.WHITESPACE) == {c for c in every if c.isspace()}
    breaks = {c for c in every if len(f"a{c}b".splitlines()) == 2}
    assert set("\n" + text.CARRIAGE_RETURN + text.RARE_BREAKS) == breaks


def expected_classes(content: str) -> tuple[int, int, int]:
    lines = [line.strip() for line in content.splitlines()]
    blank = sum(not line for line in lines)
    comment = sum(line.startswith(("//", "*", "/*")) for line in lines)
    return blank, comment, len(lines) - blank - comment


PIECES = st.sampled_from(
    ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029",
     "\x1f", " ", "\t", "\xa0", "\u3000", "\u2003", "//", "/*", "*", "/", "a", "\xe9", "code();",
     "@Test", "\ufeff", "\u200b", "*/", "\U0001f600"]
)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(PIECES, max_size=14).map("".join), min_size=150, max_size=300))
def test_line_classes_follow_the_line_rule(spark, contents):
    contents = contents + ["", "\n", "a", "a\n", "a\r\nb\r", "\x85", "/* x\ny\n*/"]
    frame = spark.createDataFrame(
        [(str(i), "A.java", content) for i, content in enumerate(contents)],
        "repository string, file string, text string",
    )
    profile = code.source_profile(frame)
    found = {
        int(row["repository"]): (row["blank"], row["comment"], row["code"])
        for row in code.line_classes(profile).collect()
    }
    assert found == {i: expected_classes(content) for i, content in enumerate(contents)}
    written = {
        int(row[0]): row[1]
        for row in frame.select("repository", text.written_line_count(F.col("text"))).collect()
    }
    assert written == {i: sum(expected_classes(c)[1:]) for i, c in enumerate(contents)}


def test_test_annotation(spark):
    values = [
        "@Test", "@Test(", "@Tests", "@ParameterizedTest", "@org.junit.Test", "// @Test @Test",
        "@Test\u00e9", "@Test_x", "@Test.x", "",
    ]
    expected = [len(re.findall(r"@Test\b", value)) for value in values]
    assert evaluate(spark, text.annotation_count, values) == expected


def test_test_files(spark):
    paths = [
        "a/src/test/X.java", "src/test/X.java", "XTest.java", "XTests.java", "Xtest.java",
        "TestX.java", "a/src/tests/X.java", "Test.java.txt", "mysrc/test/X.java",
    ]
    assert evaluate(spark, text.is_test_file, paths) == [
        True, True, True, True, False, False, False, False, False,
    ]


def test_frameworks_are_found_in_one_pass(spark):
    patterns = {
        "junit": r"org\.junit|junit\.framework", "testng": r"org\.testng",
        "mockito": r"org\.mockito", "assertj": r"org\.assertj", "spock": r"spock\.lang",
    }
    values = [
        "import org.junit.Test;", "ORG.JUNIT org.mockitorg.testng", "xorg.aSSertj", "orgxjunit",
        "junit.framework spock.lang", "org.assert\u017f", "org.mocKito", "moc\u212aito",
        "org.moc\u212aito org.a\u017f\u017fertj", "\u017fpock.lang", "",
    ]
    for name, pattern in patterns.items():
        found = evaluate(
            spark,
            lambda v, name=name: text.names_framework(text.framework_mentions(v), name),
            values,
        )
        assert found == [bool(re.search(pattern, v, re.I)) for v in values], name


def test_code_only_and_decisions(spark):
    values = [
        'if (a && b || c) { x = y ? 1 : 2; } // if while',
        'String s = "http://if?"; for (;;) {}',
        "/* if\nwhile */ case 1: catch (E e) {}",
        "char c = '\"'; while (true) {} /* open if",
        'x = "a\\"if"; diff(); iffy();',
        '"""\nif (x)\n"""; if (y) {}',
    ]

    def decisions(v):
        return text.decision_count(text.code_only(v))

    assert evaluate(spark, decisions, values) == [4, 1, 2, 1, 0, 1]


def test_long_literals_and_open_comments_stay_linear(spark):
    values = ['"' + "a\\n" * 200_000 + '"; if', "/* " * 100_000, "\n" * 300_000, "'" * 50_001]
    lengths = evaluate(spark, lambda v: F.length(text.code_only(v)), values)
    assert lengths[:3] == [5, 1, 300_000]


def test_invalid_bytes_are_left_out(spark):
    values = [b"abc", b"a\xffb\xc3", b"\xc3\xa9", b"", b"\xed\xa0\x80x", "\ufffd".encode()]
    found = evaluate(spark, trees.lenient_utf8, [bytearray(v) for v in values], "binary")
    assert found == [v.decode("utf-8", errors="ignore") for v in values]
