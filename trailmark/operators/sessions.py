"""Events to sessions: identifiers, first traffic event, funnel flags, revenue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.metrics import exact_sum
from trailmark.functions.params import int_param, session_key, string_param

# The ecommerce event names that count as funnel stages, in order.
STAGES = (
    "view_item",
    "add_to_cart",
    "begin_checkout",
    "add_shipping_info",
    "add_payment_info",
    "purchase",
)

SESSION_KEYS = ("unique_session_id", "user_pseudo_id", "ga_session_id", "ga_session_number")


def flag(stage: str) -> str:
    """Column name of a stage's flag."""
    return f"{stage}_flag"


def flat_events(events: DataFrame) -> DataFrame:
    """One narrow row per event; unused columns are pruned from the scan."""
    return events.select(
        "user_pseudo_id",
        int_param("ga_session_id").alias("ga_session_id"),
        int_param("ga_session_number").alias("ga_session_number"),
        "event_timestamp",
        "event_name",
        string_param("source").alias("event_source"),
        string_param("medium").alias("event_medium"),
        string_param("campaign").alias("event_campaign"),
        F.col("ecommerce.purchase_revenue_in_usd").alias("purchase_revenue_usd"),
    )


def identified(events: DataFrame) -> DataFrame:
    """Flat events that have a user and a session."""
    return flat_events(events).filter(
        F.col("user_pseudo_id").isNotNull() & F.col("ga_session_id").isNotNull()
    )


def sessionized(events: DataFrame) -> DataFrame:
    """Flat events with ``unique_session_id``; events lacking a user or session go."""
    return identified(events).withColumn("unique_session_id", session_key())


def has_traffic(source: str = "event_source", medium: str = "event_medium") -> Column:
    """The event names both a source and a medium."""
    return F.col(source).isNotNull() & F.col(medium).isNotNull()


def first_where(predicate: Column, order: str, *columns: str) -> Column:
    """Aggregate: (order, columns...) of the earliest row that meets ``predicate``.

    NULL if none does. Equal ``order`` values are decided by the columns, so the
    result is stable. Structs are compared in sorted rows: over raw events, go
    through :func:`candidates` first.
    """
    return F.min(F.when(predicate, F.struct(order, *columns)))


def candidates(
    rows: DataFrame,
    keys: Sequence[str],
    predicate: Column,
    order: str,
    columns: Sequence[str],
    *others: Column,
) -> DataFrame:
    """First step of finding each key's earliest row that meets ``predicate``.

    One row per key and distinct ``columns`` of rows that meet it, with their least
    ``order``, and one for the key's other rows, where all of these are NULL; the
    aggregates ``others`` are taken per row of the result. Values are group keys and
    the least ``order`` is a number, so events are hashed into buffers of fixed width
    and never sorted. ``F.min`` of :func:`candidate` over a key ends the search.
    """
    held = [F.when(predicate, F.col(c)).alias(c) for c in columns]
    return rows.groupBy(*keys, *held).agg(
        F.min(F.when(predicate, F.col(order))).alias("candidate_order"), *others
    )


def candidate(order: str, columns: Sequence[str]) -> Column:
    """The candidate that a row of :func:`candidates` holds, NULL if it holds none; equal ones differ in nothing."""
    return F.when(
        F.col("candidate_order").isNotNull(),
        F.struct(F.col("candidate_order").alias(order), *columns),
    )


def first_event_where(
    rows: DataFrame, keys: Sequence[str], predicate: Column, order: str, columns: Sequence[str]
) -> DataFrame:
    """Per key, ``first``: (order, columns...) of its earliest row that meets ``predicate``, or NULL."""
    found = candidates(rows, keys, predicate, order, columns)
    return found.groupBy(*keys).agg(F.min(candidate(order, columns)).alias("first"))


TRAFFIC = ("event_source", "event_medium", "event_campaign")


def per_session(events: DataFrame, *aggregates: Column) -> DataFrame:
    """``unique_session_id`` and the aggregates of each session's events.

    Events are grouped by the session's number and user; the text that names the
    session is made of the result.
    """
    grouped = identified(events).groupBy("ga_session_id", "user_pseudo_id").agg(*aggregates)
    names = [c for c in grouped.columns if c not in ("ga_session_id", "user_pseudo_id")]
    return grouped.select(session_key().alias("unique_session_id"), *names)


def stage_flags(stages: Sequence[str] = STAGES) -> list[Column]:
    """Aggregates: 1 if an event of the stage occurs in the group, else 0."""
    return [
        F.max(F.when(F.col("event_name") == stage, 1).otherwise(0)).alias(flag(stage))
        for stage in stages
    ]


def revenue_or_zero(total: Column) -> Column:
    return F.coalesce(total, F.lit(0.0))


def session_revenue(column: str = "purchase_revenue_usd") -> Column:
    """Aggregate: revenue over all events of the group, summed exactly, 0 if there is none."""
    return revenue_or_zero(exact_sum(column).cast("double"))


def session_facts(events: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """Acquisition, funnel flags and revenue in one pass over the events.

    One row per session and session number. Start time belongs to that row;
    attribution, flags and revenue belong to the session, so a session with
    conflicting numbers repeats them on each of its rows.

    Events are combined on the map side by session, number and traffic values, in
    buffers of fixed width, so they are hashed and not sorted. The window then spreads
    the session's values over its few rows (one per distinct number and traffic; it
    spills to disk should a faulty session have very many), and the last aggregate,
    which needs no shuffle, leaves one row per number. So neither of the two shuffles
    carries raw events and no join is needed. The session id is made last.
    """
    keys = ("ga_session_id", "user_pseudo_id", "ga_session_number")
    combined = candidates(
        identified(events),
        keys,
        has_traffic(),
        "event_timestamp",
        TRAFFIC,
        F.min("event_timestamp").alias("earliest_event_timestamp"),
        *stage_flags(stages),
        exact_sum("purchase_revenue_usd").alias("revenue"),
    )
    session = Window.partitionBy("ga_session_id", "user_pseudo_id")
    spread = combined.select(
        *keys,
        "earliest_event_timestamp",
        F.min(candidate("event_timestamp", TRAFFIC)).over(session).alias("first_traffic"),
        *[F.max(flag(stage)).over(session).alias(flag(stage)) for stage in stages],
        F.sum("revenue").over(session).alias("revenue"),
    )
    # A session's rows share all that the window spread; only the start is the number's own.
    by_number = spread.groupBy(*keys, "first_traffic").agg(
        F.min("earliest_event_timestamp").alias("earliest_event_timestamp"),
        *[F.max(flag(stage)).alias(flag(stage)) for stage in stages],
        F.max("revenue").alias("revenue"),
    )
    return by_number.select(
        session_key().alias("unique_session_id"),
        "user_pseudo_id",
        "ga_session_id",
        "ga_session_number",
        "earliest_event_timestamp",
        F.col("first_traffic.event_timestamp").alias("first_traffic_event_timestamp"),
        F.col("first_traffic.event_source").alias("session_source"),
        F.col("first_traffic.event_medium").alias("session_medium"),
        F.col("first_traffic.event_campaign").alias("session_campaign"),
        *[flag(stage) for stage in stages],
        revenue_or_zero(F.col("revenue").cast("double")).alias("session_revenue_usd"),
    )
