"""Profile of the traffic fields: values, completeness, session coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.metrics import known, pct, rows
from trailmark.functions.params import session_key, string_param
from trailmark.operators.sessions import TRAFFIC, first_event_where, flat_events, has_traffic, identified

# The traffic fields, in report order.
TRAFFIC_FIELDS = ("source", "medium", "campaign")


def _values(events: DataFrame, column, name: str) -> DataFrame:
    return events.select(column.alias(name)).distinct().orderBy(name)


def user_mediums(events: DataFrame) -> DataFrame:
    return _values(events, F.col("traffic_source.medium"), "acquisition_medium")


def user_sources(events: DataFrame) -> DataFrame:
    return _values(events, F.col("traffic_source.source"), "acquisition_source")


def user_campaigns(events: DataFrame) -> DataFrame:
    return _values(events, F.col("traffic_source.name"), "acquisition_campaign")


def event_sources(events: DataFrame) -> DataFrame:
    return _values(events, string_param("source"), "event_source")


def event_mediums(events: DataFrame) -> DataFrame:
    return _values(events, string_param("medium"), "event_medium")


def event_campaigns(events: DataFrame) -> DataFrame:
    return _values(events, string_param("campaign"), "event_campaign")


def completeness_by_event(events: DataFrame) -> DataFrame:
    """Per event type: events with each traffic field, counted and in percent."""
    return (
        flat_events(events)
        .groupBy("event_name")
        .agg(
            rows().alias("total_events"),
            *[known(f"event_{f}").alias(f"events_with_{f}") for f in TRAFFIC_FIELDS],
        )
        .select(
            "*",
            *[
                pct(f"events_with_{f}", "total_events").alias(f"{f}_completeness_pct")
                for f in TRAFFIC_FIELDS
            ],
        )
        .orderBy(F.desc("total_events"))
    )


def cooccurrence(events: DataFrame) -> DataFrame:
    """Events by which traffic fields appear together."""
    source, medium, campaign = (F.col(f"event_{f}") for f in TRAFFIC_FIELDS)
    return flat_events(events).agg(
        rows().alias("total_events"),
        *[known(f"event_{f}").alias(f"events_with_{f}") for f in TRAFFIC_FIELDS],
        F.count_if(has_traffic() & campaign.isNotNull()).alias("events_with_all_three"),
        F.count_if(has_traffic()).alias("events_with_source_and_medium"),
        F.count_if(source.isNotNull() & medium.isNull()).alias("source_without_medium"),
        F.count_if(medium.isNotNull() & source.isNull()).alias("medium_without_source"),
        F.count_if(source.isNotNull() & campaign.isNull()).alias("source_without_campaign"),
    )


def session_first_traffic(events: DataFrame) -> DataFrame:
    """First attributable event of each session; NULLs if it has none."""
    keys = ("ga_session_id", "user_pseudo_id")
    found = first_event_where(identified(events), keys, has_traffic(), "event_timestamp", TRAFFIC)
    return found.select(
        session_key().alias("unique_session_id"),
        F.col("first.event_timestamp").alias("first_traffic_event_timestamp"),
        F.col("first.event_source").alias("session_source"),
        F.col("first.event_medium").alias("session_medium"),
        F.col("first.event_campaign").alias("session_campaign"),
    )


def attribution_coverage(events: DataFrame) -> DataFrame:
    """Sessions with and without attribution."""
    attributed = F.count_if(has_traffic("session_source", "session_medium"))
    return (
        session_first_traffic(events)
        .agg(
            rows().alias("total_sessions"),
            attributed.alias("attributed_sessions"),
            (rows() - attributed).alias("unattributed_sessions"),
            known("session_campaign").alias("sessions_with_campaign"),
        )
        .select(
            "*",
            pct("attributed_sessions", "total_sessions").alias("attributed_sessions_pct"),
            pct("unattributed_sessions", "total_sessions").alias("unattributed_sessions_pct"),
        )
    )
