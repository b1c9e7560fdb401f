"""ISO-8601 text with offsets: instants for durations, text for local calendar days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Length of a calendar day and of a day with hours and minutes, and where a sign can stand that starts an offset, counted
# from the end: +hh, +hhmm and +hh:mm.
DAY_LENGTH = 10
MINUTE_LENGTH = 16
OFFSET_SIGNS = (3, 5, 6)


def iso_instant(text: Column) -> Column:
    """Timestamp of an ISO string, NULL when blank or unparsable.

    A string without an offset is read as UTC whatever the session time zone is. The
    shape is told from single characters, as commit and pull-request facts are many;
    the cast then checks the digits.
    """
    trimmed = F.trim(text)

    def char(position: int) -> Column:
        return F.substring(trimmed, position, 1)

    dated = (char(5) == "-") & (char(8) == "-")
    timed = F.length(trimmed) > DAY_LENGTH
    zoned = F.endswith(trimmed, F.lit("Z"))
    for place in OFFSET_SIGNS:
        zoned = zoned | char(-place).isin("+", "-")
    # The cast wants seconds in front of an offset.
    whole = F.when(
        char(MINUTE_LENGTH + 1) != ":",
        F.concat(
            F.left(trimmed, F.lit(MINUTE_LENGTH)),
            F.lit(":00"),
            F.substr(trimmed, F.lit(MINUTE_LENGTH + 1)),
        ),
    ).otherwise(trimmed)
    stated = (
        F.when(~timed, F.concat(trimmed, F.lit("T00:00:00Z")))
        .when(zoned, whole)
        .otherwise(F.concat(whole, F.lit("Z")))
    )
    return F.when(dated, stated.try_cast("timestamp"))


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole 24-hour periods between two instants, rounded towards the past."""
    micros = F.unix_micros(end) - F.unix_micros(start)
    return F.floor(micros / F.lit(86_400_000_000)).cast("int")


def local_day(text: Column) -> Column:
    """Calendar day as written at the committer's own offset; never shifted to UTC."""
    return F.substring(text, 1, 10)


def elapsed_hours(start: Column, end: Column) -> Column:
    seconds = (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000)
    return seconds / F.lit(3600.0)
