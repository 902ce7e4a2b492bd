"""Time expressions. No operator reads a clock: ``as_of`` is always an argument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def as_of_column(as_of: Column | dt.datetime | str) -> Column:
    """A UTC instant given as a column, a datetime or ISO text."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=dt.timezone.utc)
    millis = (as_of - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(milliseconds=1)
    return F.timestamp_millis(F.lit(millis))


def iso_utc(ts: Column) -> Column:
    """``2024-01-20T00:00:00.000Z`` (the session time zone is UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_zoned(text: Column) -> Column:
    """Timestamp of an ISO-8601 text that names its zone, or of a date alone, which
    is midnight UTC; null for all others.

    A time without a zone would mean the reader's own zone, so it is refused.
    """
    zoned = text.rlike(
        r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})\z")
    # Spark wants seconds before a zone, the format does not.
    full = F.regexp_replace(text, r"(T\d{2}:\d{2})(Z|[+-])", "$1:00$2")
    full = F.when(zoned, full).when(
        text.rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.concat(text, F.lit("T00:00:00Z")))
    return F.timestamp_millis(F.unix_millis(full.try_cast("timestamp")))


def _whole(ms: Column, unit: int) -> Column:
    return F.floor(ms / F.lit(unit)).cast("long")


def _two(value: Column) -> Column:
    return F.lpad(value.cast("string"), 2, "0")


def time_left(end: Column, now: Column) -> Column:
    """``Ended`` or ``[Nd ]HH:MM:SS`` until ``end``."""
    ms = F.unix_millis(end) - F.unix_millis(now)
    days = _whole(ms, DAY)
    clock = F.concat_ws(":", _two(_whole(ms % DAY, HOUR)), _two(_whole(ms % HOUR, MINUTE)),
                        _two(_whole(ms % MINUTE, SECOND)))
    prefix = F.when(days > 0, F.concat(days.cast("string"), F.lit("d "))).otherwise("")
    return F.when(ms > 0, F.concat(prefix, clock)).otherwise("Ended")


def time_ago(then: Column, now: Column) -> Column:
    """``just now``, ``5m ago``, ``3h ago`` or ``2d ago``; the future is just now."""
    ms = F.unix_millis(now) - F.unix_millis(then)

    def ago(unit: int, letter: str) -> Column:
        return F.concat(_whole(ms, unit).cast("string"), F.lit(f"{letter} ago"))

    return (F.when(ms < MINUTE, "just now").when(ms < HOUR, ago(MINUTE, "m"))
            .when(ms < DAY, ago(HOUR, "h")).otherwise(ago(DAY, "d")))
