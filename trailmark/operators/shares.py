"""Share of a grand total."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.metrics import money_pct, pct


def share_over_labels(grouped: DataFrame, measure: str, name: str) -> DataFrame:
    """Add ``measure`` in percent of its total, for groups keyed by fixed labels.

    The total is a window over all rows, which is one task: use it only where the
    number of groups is fixed (channels, session types, segments).
    """
    return grouped.withColumn(name, pct(measure, F.sum(measure).over(Window.partitionBy())))


def money_share_over_labels(grouped: DataFrame, measure: str, name: str) -> DataFrame:
    """The same for a decimal amount, computed exactly."""
    total = F.sum(measure).over(Window.partitionBy())
    return grouped.withColumn(name, money_pct(measure, total))


def share_over_values(grouped: DataFrame, measure: str, name: str) -> DataFrame:
    """Add ``measure`` in percent of its total, for groups keyed by data values.

    The total is a scalar subquery, so the groups stay distributed however many
    there are. Both sides share the shuffle of the grouping.
    """
    total = grouped.agg(F.sum(measure)).scalar()
    return grouped.withColumn(name, pct(F.col(measure), total))
