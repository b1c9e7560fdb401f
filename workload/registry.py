"""Registration of queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload.views import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Register a function under its name; ``views`` are those the SQL names."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = with_views(oracle, *views)
        return function

    return register


def rounded(value: str, digits: int) -> str:
    """SQL for the correctly rounded decimal places of a double."""
    return f"cast(printf('%.{digits}f', {value}) as double)"


def mean(value: str) -> str:
    """SQL for a mean to two places, summed as decimals so that ties fall one way."""
    total = f"cast(sum(cast({value} as decimal(28, 10))) as double)"
    return f"round_even({total} / nullif(count({value}), 0), 2)"
