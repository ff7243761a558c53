"""Counts, rates, ratios and money. One rule rounds them all: exactly, to two decimals, halves away from zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _count(value: Column | str) -> Column:
    return _col(value).cast("decimal(20,0)")


def _hundredths(part: Column, whole: Column, scale: int) -> Column:
    """``scale * part / whole`` of decimals that are not negative, rounded to an integer, halves up.

    Only integer division is used, so no digit is lost before the rounding. NULL if ``whole`` is 0.
    """
    double = F.lit(2 * scale).cast("decimal(10,0)")
    over = F.nullif(whole, F.lit(0).cast("decimal(20,0)"))
    return F.call_function("div", part * double + whole, over * F.lit(2).cast("decimal(1,0)"))


def _per(part: Column, whole: Column, scale: int) -> Column:
    """The same of decimals of either sign, halves away from zero, as a double."""
    sign = (F.signum(part) * F.signum(whole)).cast("long")
    return sign * _hundredths(F.abs(part), F.abs(whole), scale) / 100


def pct(part: Column | str, whole: Column | str) -> Column:
    """A count in percent of another; NULL if ``whole`` is 0."""
    return _hundredths(_count(part), _count(whole), 10_000) / 100


def ratio(part: Column | str, whole: Column | str) -> Column:
    """A count per another; NULL if ``whole`` is 0."""
    return _hundredths(_count(part), _count(whole), 100) / 100


def exact_sum(column: str) -> Column:
    """Aggregate: sum of money as a decimal, so it depends neither on order nor on partitions.

    Each amount is first rounded to six decimals (halves away from zero); amounts may have 22 digits before the point,
    their sum 32.
    """
    return F.sum(F.col(column).cast("decimal(28,6)"))


def cents(money: Column | str) -> Column:
    """A decimal amount, as a double."""
    return F.round(_col(money), 2).cast("double")


def money_per(money: Column | str, whole: Column | str) -> Column:
    """A decimal amount per a count; NULL if ``whole`` is 0."""
    return _per(_col(money), _count(whole), 100)


def money_pct(part: Column | str, whole: Column | str) -> Column:
    """A decimal amount in percent of another; NULL if ``whole`` is 0."""
    return _per(_col(part), _col(whole), 10_000)


def rows() -> Column:
    return F.count(F.lit(1))


def known(column: str) -> Column:
    """Aggregate: rows where ``column`` is set."""
    return F.count(F.col(column))


def missing(column: str) -> Column:
    """Aggregate: rows where ``column`` is not set."""
    return F.count_if(F.col(column).isNull())
