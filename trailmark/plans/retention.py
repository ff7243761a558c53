"""Reports and checks over the two cohort tables, for any horizons that the tables hold."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.metrics import pct, rows
from trailmark.operators.cohorts import HORIZONS


def _counts(n: int) -> tuple[str, str]:
    """The additive measures of a horizon, in report order."""
    return f"d{n}_eligible_users", f"d{n}_retained_users"


def _measures(horizons: Sequence[int]) -> list[str]:
    return ["cohort_size", *[c for n in horizons for c in (*_counts(n), f"d{n}_retention_rate")]]


def _additive(horizons: Sequence[int]) -> list[str]:
    return [c for n in horizons for c in _counts(n)]


def _sums(horizons: Sequence[int]) -> list[Column]:
    return [
        F.sum("cohort_size").alias("cohort_users"),
        *[F.sum(c).alias(c) for c in _additive(horizons)],
    ]


def totals(cohorts: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Overall counts and rates of a cohort table."""
    measures = []
    for n in horizons:
        eligible, retained = _counts(n)
        rate = pct(retained, eligible).alias(f"overall_d{n}_retention_rate")
        measures += [eligible, retained, rate]
    return cohorts.agg(*_sums(horizons)).select("cohort_users", *measures)


def reconcile(
    weekly: DataFrame, channel: DataFrame, horizons: Sequence[int] = HORIZONS
) -> DataFrame:
    """Totals of both tables side by side. Expected: every match is true."""
    sides = (
        weekly.agg(*_sums(horizons))
        .withColumn("side", F.lit("weekly"))
        .unionByName(channel.agg(*_sums(horizons)).withColumn("side", F.lit("channel")))
    )
    # Two rows, one per table, folded into one.
    out = []
    for column in ("cohort_users", *_additive(horizons)):
        short = column if column == "cohort_users" else column.removesuffix("_users")
        pair = [F.max(F.when(F.col("side") == s, F.col(column))) for s in ("weekly", "channel")]
        out += [
            pair[0].alias(f"weekly_{short}"),
            pair[1].alias(f"channel_{short}"),
            (pair[0] == pair[1]).alias(f"{short}_match"),
        ]
    return sides.agg(*out)


def review_channel(channel: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Channels by the rate of the first horizon."""
    return channel.select("channel_group", *_measures(horizons)).orderBy(
        F.desc(f"d{horizons[0]}_retention_rate")
    )


def review_weekly(weekly: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    return weekly.select("cohort_week", *_measures(horizons)).orderBy("cohort_week")


def impossible_counts(
    weekly: DataFrame, channel: DataFrame, horizons: Sequence[int] = HORIZONS
) -> DataFrame:
    """Rows with more retained than eligible users, per table. Expected: none."""

    def invalid(cohorts: DataFrame, model: str) -> DataFrame:
        broken = [F.col(_counts(n)[1]) > F.col(_counts(n)[0]) for n in horizons]
        return (
            cohorts.filter(reduce(Column.__or__, broken))
            .agg(rows().alias("invalid_rows"))
            .select(F.lit(model).alias("model"), "invalid_rows")
        )

    return invalid(weekly, "Weekly Cohort").unionByName(invalid(channel, "Channel Retention"))


def cohort_eligibility(weekly: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Share of each weekly cohort that can be observed long enough."""
    eligible = [_counts(n)[0] for n in horizons]
    return weekly.select(
        "cohort_week",
        "cohort_size",
        *eligible,
        *[
            pct(column, "cohort_size").alias(f"d{n}_eligibility_pct")
            for n, column in zip(horizons, eligible)
        ],
    ).orderBy("cohort_week")


def cohort_matrix(long: DataFrame) -> DataFrame:
    """One row per weekly cohort and horizon, with the rate; blank if not observable."""
    return long.orderBy("cohort_week", "horizon").select(
        "cohort_week",
        "cohort_size",
        F.concat(F.lit("D"), "horizon").alias("horizon"),
        pct("retained_users", "eligible_users").alias("retention_rate"),
    )
