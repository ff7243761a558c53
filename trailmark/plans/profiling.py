"""Profile of the raw events: volumes, periods, identifier completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.calendar import shard_day
from trailmark.functions.metrics import known, missing, pct, ratio, rows
from trailmark.functions.params import int_param, param_count, session_key
from trailmark.operators.sessions import flat_events, identified
from trailmark.operators.shares import share_over_values

# Parameters the models look up.
LOOKUP_KEYS = ("ga_session_id", "ga_session_number", "source", "medium", "campaign")


def event_distribution(events: DataFrame) -> DataFrame:
    return (
        events.groupBy("event_name").agg(rows().alias("event_count")).orderBy(F.desc("event_count"))
    )


def dataset_profile(events: DataFrame) -> DataFrame:
    # As numbers, so that the aggregate hashes: a string's minimum would make it sort all events.
    day = F.col("event_date").try_cast("int")
    return events.agg(
        F.min(day).cast("string").alias("first_day"),
        F.max(day).cast("string").alias("last_day"),
        rows().alias("total_events"),
        F.count_distinct("user_pseudo_id").alias("distinct_users"),
    ).select(
        shard_day("first_day").alias("earliest_event_date"),
        shard_day("last_day").alias("latest_event_date"),
        "total_events",
        "distinct_users",
    )


def completeness(df: DataFrame, column: str, present: str, absent: str, share: str) -> DataFrame:
    """Rows with and without ``column``, and the percentage with it."""
    return df.agg(
        rows().alias("total_events"),
        known(column).alias(present),
        missing(column).alias(absent),
        pct(known(column), rows()).alias(share),
    )


def session_id_completeness(events: DataFrame) -> DataFrame:
    return completeness(
        events.select(int_param("ga_session_id").alias("ga_session_id")),
        "ga_session_id",
        "events_with_session_id",
        "events_without_session_id",
        "session_id_completeness_pct",
    )


def user_id_completeness(events: DataFrame) -> DataFrame:
    return completeness(
        events,
        "user_pseudo_id",
        "events_with_user_id",
        "events_without_user_id",
        "user_id_completeness_pct",
    )


def volumes(events: DataFrame) -> DataFrame:
    """Distinct users and sessions, and events, with incomplete rows included.

    Events are first counted per (user, session id), so the two distinct counts
    expand session rows instead of event rows.
    """
    per_session = (
        flat_events(events).groupBy("user_pseudo_id", "ga_session_id").agg(rows().alias("events"))
    )
    return per_session.agg(
        F.count_distinct("user_pseudo_id").alias("total_distinct_users"),
        F.count_distinct(session_key()).alias("total_distinct_sessions"),
        F.coalesce(F.sum("events"), F.lit(0)).alias("total_events"),
    )


def top_sessions(events: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` sessions with the most events; ties by session id."""
    return (
        identified(events)
        .groupBy("user_pseudo_id", "ga_session_id")
        .agg(rows().alias("event_count"))
        .select("user_pseudo_id", session_key().alias("unique_session_id"), "event_count")
        .orderBy(F.desc("event_count"), "unique_session_id")
        .limit(n)
    )


def sessions_by_user(events: DataFrame) -> DataFrame:
    """Distinct sessions of each user.

    Within a user the session id alone tells sessions apart. The distinct count
    first reduces to (user, session) pairs, so a heavy user is not one task's work.
    """
    return (
        identified(events)
        .groupBy("user_pseudo_id")
        .agg(F.count_distinct("ga_session_id").alias("session_count"))
    )


def sessions_per_user(events: DataFrame) -> DataFrame:
    return sessions_by_user(events).agg(
        rows().alias("total_distinct_users"),
        F.sum("session_count").alias("total_distinct_sessions"),
        ratio(F.sum("session_count"), rows()).alias("average_sessions_per_user"),
        F.min("session_count").alias("minimum_sessions_per_user"),
        F.max("session_count").alias("maximum_sessions_per_user"),
    )


def session_frequency(events: DataFrame) -> DataFrame:
    """Users by number of sessions, with their share."""
    histogram = (
        sessions_by_user(events)
        .groupBy(F.col("session_count").alias("sessions_per_user"))
        .agg(rows().alias("number_of_users"))
    )
    return share_over_values(histogram, "number_of_users", "percentage_of_users").orderBy(
        "sessions_per_user"
    )


def duplicate_params(events: DataFrame) -> DataFrame:
    """Events that repeat a looked-up parameter, per key. Expected: all zero.

    A lookup takes the first value, so repeats would pass unnoticed otherwise.
    """
    counts = events.agg(
        *[F.count_if(param_count(key) > 1).alias(key) for key in LOOKUP_KEYS]
    )
    return counts.unpivot([], list(LOOKUP_KEYS), "param_key", "events_with_repeats")
