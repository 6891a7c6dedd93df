"""Times as 100 ns ticks since year 1, and file times."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Ticks at the unix epoch, and file-time units at it.
UNIX_TICKS, UNIX_FILETIME = 621355968000000000, 116444736000000000


def to_ticks(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * 10 + UNIX_TICKS


def from_ticks(t: Column) -> Column:
    """A timestamp; the last digit below a microsecond goes."""
    return F.timestamp_micros(((t - UNIX_TICKS) / 10).cast("bigint"))


def span_ticks(days: Column, hours: Column, minutes: Column, seconds: Column, nanos: Column) -> Column:
    return (((days * 24 + hours) * 60 + minutes) * 60 + seconds) * 10_000_000 + F.floor(nanos / 100)


def filetime_seconds(ft: Column) -> Column:
    return F.floor((ft - UNIX_FILETIME) / 10_000_000).cast("bigint")


def is_leap(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
