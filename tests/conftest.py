from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from codestrata.session import configured  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = configured(
        SparkSession.builder.master("local[8]").appName("tests"),
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="6g",
        spark__sql__warehouse__dir=str(shared / "warehouse"),
        spark__checkpoint__dir=str(shared / "checkpoints"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Build a DataFrame from a schema and tuples."""

    def build(schema: str, *values: tuple):
        return spark.createDataFrame(list(values), schema)

    return build


def dicts(frame, key=None):
    collected = [row.asDict() for row in frame.collect()]
    return {row[key]: row for row in collected} if key else collected
