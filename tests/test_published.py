"""Values published for real repositories, recomputed from the values they follow from.

Fixed values: committed dates and spans, test line counts and ratios, and indicator rows.
"""

from __future__ import annotations

import pytest
from conftest import dicts
from pyspark.sql import functions as F

from codestrata.functions.instants import elapsed_days, iso_instant
from codestrata.functions.numeric import ratio_or_zero
from codestrata.operators.people import concentration_risk
from codestrata.plans import indicators, report
from codestrata.sources.landed import empty_table

SPANS = [
    ("2018-10-06T19:38:31+08:00", "2026-05-03T08:58:41+08:00", 2765),
    ("2010-02-08T15:22:27+02:00", "2026-05-31T22:42:08+02:00", 5956),
    ("2014-08-09T19:52:29+03:00", "2026-05-31T18:18:10+03:00", 4312),
    ("2019-02-28T22:27:49-05:00", "2026-05-29T11:08:59-04:00", 2646),
    ("2012-10-21T10:53:52-07:00", "2026-05-31T20:21:26+02:00", 4970),
    ("2008-07-10T22:00:24+00:00", "2026-05-29T13:31:01+02:00", 6531),
    ("2015-10-25T15:27:32+01:00", "2026-04-07T04:11:27+05:00", 3816),
    ("2016-07-16T15:51:03+05:30", "2026-05-31T22:21:18+02:00", 3606),
]

# main lines, test lines, ratio
RATIOS = [
    (269797, 246069, 0.9121), (780536, 423544, 0.5426), (8, 0, 0.0), (2456809, 1441026, 0.5865),
    (72837, 37359, 0.5129), (2124769, 632679, 0.2978), (43075, 26573, 0.6169),
    (755102, 518687, 0.6869), (34600, 2928, 0.0846), (71472, 45404, 0.6353),
]

# name, commits, active days, share, risk, open, closed, activity
ACTIVITY = [
    ("ghidra", 17554, 1986, 59.51, "low", 133, 167, 27784),
    ("Java", 3204, 1284, 29.08, "low", 20, 280, 9924),
    ("alibaba_nacos", 0, 0, 0.0, "low", 0, 0, 0),
    ("advanced-java", 785, 441, 84.41, "high", 0, 142, 3132),
    ("elasticsearch", 100700, 5395, 14.55, "low", 125, 175, 127975),
    ("java-design-patterns", 4364, 1122, 53.5, "low", 86, 214, 10274),
    ("spring-boot", 61387, 3689, 50.89, "low", 20, 280, 80132),
    ("spring-framework", 35064, 4899, 42.58, "low", 63, 237, 59859),
    ("termux-app", 1504, 490, 85.71, "high", 49, 251, 4254),
]


def test_spans(rows):
    frame = rows("a string, b string, days int", *SPANS)
    days = elapsed_days(iso_instant(F.col("a")), iso_instant(F.col("b")))
    assert frame.filter(days == F.col("days")).count() == len(SPANS)


def test_ratios(rows):
    frame = rows("main long, test long, ratio double", *RATIOS)
    ratio = ratio_or_zero(F.col("test"), F.col("main"), 4)
    assert frame.filter(ratio == F.col("ratio")).count() == len(RATIOS)


def test_activity_and_risk(rows):
    frame = rows(
        "name string, total_commits long, active_days long, share double, risk string,"
        "pr_open long, pr_closed long, score long",
        *ACTIVITY,
    )
    same = (indicators.activity_score() == F.col("score")) & (
        concentration_risk(F.col("share")) == F.col("risk")
    )
    assert frame.filter(same).count() == len(ACTIVITY)


@pytest.fixture
def mart(spark, rows):
    """The mart of the published rows, from tables that hold the published totals."""
    names = ("repositories", "developers", "structure", "complexity")
    tables = {name: empty_table(spark, name) for name in names}
    tables["commits"] = rows(
        "repository string, total_commits long, distinct_active_days int",
        *[(name, commits, days) for name, commits, days, *_ in ACTIVITY if commits],
    )
    tables["loc"] = rows("repository string, code long", ("alibaba_nacos", 383591))
    tables["tests"] = rows("repository string, test_methods long", ("alibaba_nacos", 11712))
    pulls = [
        (name, state)
        for name, _, _, _, _, opened, closed, _ in ACTIVITY
        for state in ["open"] * opened + ["closed"] * closed
    ]
    tables["pull_requests"] = rows(
        "repository string, state string, commits long, hours_to_close double",
        *[(name, state, 1, 2.5) for name, state in pulls],
    )
    return indicators.quality_indicators(tables)


def test_activity_ranking(mart):
    ranked = [row["repository"] for row in report.activity_ranking(mart).collect()]
    expected = sorted(ACTIVITY, key=lambda row: (-row[-1], row[0]))
    assert ranked == [row[0] for row in expected]


def test_a_key_that_joins_nothing_is_all_defaults(mart):
    row = dicts(mart, "repository")["alibaba_nacos"]
    kept = {"repository": "alibaba_nacos", "total_loc": 383591, "test_methods": 11712,
            "concentration_risk": "low"}
    assert {k: v for k, v in row.items() if v} == kept
