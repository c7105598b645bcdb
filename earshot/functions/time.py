"""Column functions over instants, calendar fields and fixed-width time slices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text forms of the two date columns.
PLAY_TIME_PATTERN = "yyyy-MM-dd'T'HH:mm:ssX"
REGISTRATION_PATTERN = "MMM d, yyyy"


def play_time(text: Column) -> Column:
    """ISO instant with a zone to a timestamp; NULL when it cannot be read."""
    return F.try_to_timestamp(text, F.lit(PLAY_TIME_PATTERN))


def registration_date(text: Column) -> Column:
    """``Aug 3, 2006`` or ``Aug 13, 2006`` to a date; NULL when it cannot be read."""
    return F.try_to_timestamp(F.trim(text), F.lit(REGISTRATION_PATTERN)).cast("date")


def naive_epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a TIMESTAMP_NTZ, truncated, whatever the session zone.

    ``timestampdiff`` would go through the session zone and shift instants that a change to
    summer time skips. An interval cast to a number counts seconds, hence the factor.
    """
    since = ts - F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    return (since * 1000).cast("long")


def plus_ms(ts: Column, ms: Column) -> Column:
    """``ts`` moved by a bigint number of milliseconds; months of them do not overflow."""
    return F.timestamp_add("MILLISECOND", ms, ts)


def slice_start(ts_ms: Column, width_ms: int) -> Column:
    """Start of the ``width_ms`` wide slice of time that holds ``ts_ms``, in long arithmetic."""
    return ts_ms - F.pmod(ts_ms, F.lit(width_ms).cast("long"))


def day_of_week(ts: Column) -> Column:
    """Sunday is 1."""
    return F.dayofweek(ts)


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)
