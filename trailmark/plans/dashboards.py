"""Datasets behind the dashboard pages, over the final session table."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.calendar import as_day
from trailmark.functions.metrics import cents, exact_sum, money_per, pct, rows
from trailmark.operators.sessions import STAGES, flag
from trailmark.operators.shares import money_share_over_labels, share_over_labels


def selected(
    sessions: DataFrame,
    start: datetime.date | str | None = None,
    end: datetime.date | str | None = None,
    channels: Sequence[str] | None = None,
) -> DataFrame:
    """Sessions of a date range (inclusive) and of some channels; all by default.

    The range is stated for months too, which are the folders of a stored session table.
    """
    for day, inside in ((start, Column.__ge__), (end, Column.__le__)):
        if day is not None:
            date = as_day(day)
            sessions = sessions.filter(
                inside(F.col("session_month"), F.lit(date.replace(day=1)))
                & inside(F.col("session_date"), F.lit(date))
            )
    if channels is not None:
        sessions = sessions.filter(F.col("channel_group").isin(*channels))
    return sessions


def _kpis(sessions: DataFrame, *keys: Column | str) -> DataFrame:
    """Users, sessions, revenue, conversion and revenue per session, per group.

    Users are first reduced to one row per user and group, so the distinct count
    needs neither an expand nor all of a group's users in one task.
    """
    per_user = sessions.groupBy(*keys, "user_pseudo_id").agg(
        rows().alias("n"),
        F.sum("purchase_flag").alias("bought"),
        exact_sum("session_revenue_usd").alias("earned"),
    )
    names = per_user.columns[: len(keys)]
    return (
        per_user.groupBy(*names)
        .agg(
            F.count("user_pseudo_id").alias("users"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("sessions"),
            F.sum("bought").alias("purchase_sessions"),
            exact_sum("earned").alias("revenue"),
        )
        .select(
            *names,
            "users",
            "sessions",
            "purchase_sessions",
            cents("revenue").alias("revenue_usd"),
            pct("purchase_sessions", "sessions").alias("conversion_rate"),
            money_per("revenue", "sessions").alias("revenue_per_session_usd"),
        )
    )


def kpi_summary(
    sessions: DataFrame,
    start: datetime.date | str | None = None,
    end: datetime.date | str | None = None,
    channels: Sequence[str] | None = None,
) -> DataFrame:
    """Headline figures of the selected sessions."""
    return _kpis(selected(sessions, start, end, channels))


def performance_over_time(sessions: DataFrame, grain: str = "session_date") -> DataFrame:
    """Headline figures per ``session_date`` or ``session_month``."""
    return _kpis(sessions, grain).orderBy(grain)


def channel_overview(sessions: DataFrame) -> DataFrame:
    return _kpis(sessions, "channel_group").orderBy(F.desc("sessions"))


def user_type_value(sessions: DataFrame) -> DataFrame:
    """Sessions, conversion and revenue of new and returning sessions, with shares."""
    grouped = sessions.groupBy("session_type").agg(
        rows().alias("sessions"),
        F.sum("purchase_flag").alias("purchase_sessions"),
        exact_sum("session_revenue_usd").alias("revenue"),
    )
    shared = money_share_over_labels(
        share_over_labels(grouped, "sessions", "session_share_pct"), "revenue", "revenue_share_pct"
    )
    return shared.select(
        "session_type",
        "sessions",
        "session_share_pct",
        "purchase_sessions",
        pct("purchase_sessions", "sessions").alias("conversion_rate"),
        cents("revenue").alias("revenue_usd"),
        "revenue_share_pct",
        money_per("revenue", "sessions").alias("revenue_per_session_usd"),
    ).orderBy("session_type")


def user_type_funnel_from_view(
    sessions: DataFrame, stages: Sequence[str] = STAGES
) -> DataFrame:
    """Of the sessions with the first stage (a product view): percentage reaching each later one, by type."""
    later = stages[1:]
    counts = (
        sessions.filter(F.col(flag(stages[0])) == 1)
        .groupBy("session_type")
        .agg(
            rows().alias("view_sessions"),
            *[F.sum(flag(stage)).alias(f"{stage}_sessions") for stage in later],
        )
    )
    return counts.select(
        "*", *[pct(f"{s}_sessions", "view_sessions").alias(f"{s}_pct") for s in later]
    ).orderBy("session_type")
