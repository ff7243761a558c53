"""Calendar fields of epoch microseconds. Days are UTC whatever the session zone is."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000
EPOCH = datetime.date(1970, 1, 1)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def epoch_day(micros: Column | str) -> Column:
    """Whole UTC days from the epoch to epoch microseconds, in integers only; days before the epoch are negative."""
    t = _col(micros)
    return F.call_function("div", t - F.pmod(t, F.lit(MICROS_PER_DAY)), F.lit(MICROS_PER_DAY)).cast("int")


def utc_date(micros: Column | str) -> Column:
    """UTC calendar day of epoch microseconds."""
    return F.date_from_unix_date(epoch_day(micros))


def as_day(day: datetime.date | str) -> datetime.date:
    """A date, or the one that a text such as ``2020-12-01`` names."""
    return day if isinstance(day, datetime.date) else datetime.date.fromisoformat(day)


def first_micros(day: datetime.date | str) -> int:
    """Epoch microseconds at which a UTC day begins."""
    return (as_day(day) - EPOCH).days * MICROS_PER_DAY


def within_utc_days(
    micros: Column | str, start: datetime.date | str | None = None, end: datetime.date | str | None = None
) -> Column:
    """Condition: epoch microseconds lie on the UTC days ``start`` to ``end``, both included; a missing bound is open.

    The days are translated, not the column, so the bounds reach the scan. NULL counts as outside of any bound.
    """
    t, found = _col(micros), F.lit(True)
    if start is not None:
        found = found & (t >= F.lit(first_micros(start)))
    if end is not None:
        found = found & (t < F.lit(first_micros(as_day(end) + datetime.timedelta(days=1))))
    return found


def month_start(day: Column | str) -> Column:
    return F.trunc(day, "MONTH")


def week_start(day: Column | str) -> Column:
    """Monday of the week."""
    return F.trunc(day, "WEEK")


def shard_day(text: Column | str) -> Column:
    """Date of a ``yyyyMMdd`` string; NULL if it is not one."""
    return F.try_to_date(text, "yyyyMMdd")
