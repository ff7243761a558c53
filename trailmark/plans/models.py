"""The derived session and user tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.calendar import month_start, utc_date
from trailmark.functions.labels import session_type
from trailmark.functions.metrics import cents, exact_sum
from trailmark.operators.sessions import (
    SESSION_KEYS,
    STAGES,
    flag,
    per_session,
    session_facts,
    session_revenue,
    stage_flags,
)
from trailmark.rules import DEFAULT, Rules
ACQUISITION_COLUMNS = (
    *SESSION_KEYS,
    "earliest_event_timestamp",
    "first_traffic_event_timestamp",
    "session_source",
    "session_medium",
    "session_campaign",
)


def flags(rules: Rules = DEFAULT) -> list[str]:
    return [flag(stage) for stage in rules.stages]


def marketing_columns(rules: Rules = DEFAULT) -> list[str]:
    return [*ACQUISITION_COLUMNS, "channel_group", *flags(rules), "session_revenue_usd"]


def session_acquisition(events: DataFrame) -> DataFrame:
    """Start time and traffic attribution per session and session number."""
    return acquisition_of(session_facts(events))


def session_ecommerce_performance(events: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Funnel flags and revenue per session."""
    return per_session(
        events, *stage_flags(rules.stages), session_revenue().alias("session_revenue_usd")
    )


def session_marketing_performance(
    acquisition: DataFrame, ecommerce: DataFrame, rules: Rules = DEFAULT
) -> DataFrame:
    """Acquisition with its channel and, where present, flags and revenue.

    For the two tables as given; stored with the same buckets of the session id they
    join without a shuffle. From events, :func:`marketing_of` on ``session_facts``
    gives the same rows without this join.
    """
    return acquisition.join(ecommerce, "unique_session_id", "left").select(
        *ACQUISITION_COLUMNS,
        rules.channel().alias("channel_group"),
        *[F.coalesce(name, F.lit(0)).alias(name) for name in flags(rules)],
        F.coalesce("session_revenue_usd", F.lit(0.0)).alias("session_revenue_usd"),
    )


def calendar(facts: DataFrame) -> DataFrame:
    """Session facts with the day and the month of the session's start."""
    day = utc_date("earliest_event_timestamp")
    return facts.withColumns({"session_date": day, "session_month": month_start(day)})


def classified(facts: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Session facts with channel, day and month: the columns that reports filter by."""
    return calendar(facts).withColumn("channel_group", rules.channel())


def acquisition_of(facts: DataFrame) -> DataFrame:
    """Acquisition table as a projection of session facts."""
    return facts.select(*ACQUISITION_COLUMNS)


def ecommerce_of(facts: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Ecommerce table from session facts; repeated session values collapse."""
    return facts.groupBy("unique_session_id").agg(
        *[F.max(name).alias(name) for name in flags(rules)],
        F.max("session_revenue_usd").alias("session_revenue_usd"),
    )


def marketing_of(facts: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Marketing table as a projection of session facts."""
    return classified(facts, rules).select(*marketing_columns(rules))


def final_of(facts: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Final session table as a projection of :func:`classified` facts; unclassifiable rows go.

    Channel, day and month are read as stored, so conditions on them reach the scan.
    """
    # The condition for having a type, in a form that reaches the scan.
    return facts.filter(F.col("ga_session_number") >= 1).select(
        *marketing_columns(rules),
        F.timestamp_micros("earliest_event_timestamp").alias("session_timestamp"),
        "session_date",
        "session_month",
        session_type().alias("session_type"),
    )


def session_model_final(marketing: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Marketing rows with calendar fields and session type; unclassifiable rows go."""
    return final_of(calendar(marketing), rules)


def user_purchase_frequency(sessions: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """One row per purchaser: purchasing sessions, revenue, dates and segment."""
    return (
        sessions.filter(F.col("purchase_flag") == 1)
        .groupBy("user_pseudo_id")
        .agg(
            F.count_distinct("unique_session_id").alias("purchase_count"),
            cents(exact_sum("session_revenue_usd")).alias("total_revenue_usd"),
            F.min("session_date").alias("first_purchase_date"),
            F.max("session_date").alias("last_purchase_date"),
        )
        .withColumn("frequency_group", rules.segment())
    )
