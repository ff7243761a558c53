"""The driver's ``events`` table as a nested event log (see FIXTURES.md).

Every event is kept. Sessions are cut where a user is silent for more than a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.functions.calendar import MICROS_PER_DAY
from trailmark.sources.event_log import EVENT_SCHEMA

# The mapping of FIXTURES.md.
SOURCE_START = 1_704_067_200_000_000  # 2024-01-01, first day of the given events
SOURCE_DAYS = 30
LOG_START = 1_604_188_800_000_000  # 2020-11-01, first day of the event log
LOG_DAYS = 90
JOIN_STEP, JOIN_DAYS = 7, 88
EVENT_NAMES = (
    ("view", "view_item"),
    ("click", "add_to_cart"),
    ("purchase", "purchase"),
    ("error", "page_view"),
)
SIGNUP_NAMES = ("begin_checkout", "add_shipping_info", "add_payment_info")
# first k, last k, source, medium, campaign
TRAFFIC = (
    (44, 44, None, "organic", None),
    (45, 54, "(direct)", "(none)", "(direct)"),
    (55, 62, "google", "organic", "(organic)"),
    (63, 65, "google", "cpc", "holiday_sale"),
    (66, 67, "google", "cpc", None),
    (68, 73, "shop.googlemerchandisestore.com", "referral", "(referral)"),
    (74, 79, "partner.example", "referral", "(referral)"),
    (80, 83, "newsletter", "email", "nov_news"),
    (84, 87, "affil.example", "affiliate", "<Other>"),
    (88, 91, "<Other>", "<Other>", "<Other>"),
    (92, 94, "(data deleted)", "(data deleted)", "(data deleted)"),
    (95, 97, "youtube", "video", "brand_video"),
    (98, 99, "solo", None, "orphan"),
)
# user_id % 5, medium, source, name
USER_TRAFFIC = (
    (0, "organic", "google", "(organic)"),
    (1, "(none)", "(direct)", "(direct)"),
    (2, "<Other>", "<Other>", "<Other>"),
    (4, "referral", "shop.googlemerchandisestore.com", "(referral)"),
)


def _micros(events: DataFrame) -> Column:
    """Epoch microseconds of ``ts``, independent of the session time zone."""
    if isinstance(events.schema["ts"].dataType, T.TimestampType):
        return F.unix_micros("ts")
    day = F.unix_date(F.to_date("ts")).cast("long") * MICROS_PER_DAY
    minutes = (F.hour("ts") * 60 + F.minute("ts")).cast("long")
    seconds = F.extract(F.lit("SECOND"), F.col("ts"))
    return day + minutes * 60_000_000 + (seconds * 1_000_000).cast("long")


def _first_match(pairs: list[tuple[Column, Column]]) -> Column:
    chain = F.when(*pairs[0])
    for condition, result in pairs[1:]:
        chain = chain.when(condition, result)
    return chain


def timed_events(events: DataFrame) -> DataFrame:
    """Events on the 90-day calendar: user u starts u-dependently late and runs to the end."""
    late = (F.col("user_id") * JOIN_STEP) % JOIN_DAYS
    stretched = (_micros(events) - SOURCE_START) * (LOG_DAYS - late)
    et = F.lit(LOG_START) + late * MICROS_PER_DAY + (
        (stretched - F.pmod(stretched, F.lit(SOURCE_DAYS))) / SOURCE_DAYS
    ).cast("long")
    return (
        events.withColumn("et", et)
        .withColumn("day", ((F.col("et") - F.pmod("et", F.lit(MICROS_PER_DAY))) / MICROS_PER_DAY).cast("int"))
        .withColumn("k", F.get_json_object("props", "$.k").cast("int"))
        .select("event_id", "user_id", "event_type", "value", "k", "et", "day")
    )


def session_days(timed: DataFrame) -> DataFrame:
    """Session number and start for each (user, UTC day) with events.

    A break is a silence of more than 24 h, so events of one UTC day are never
    split: only each day's first and last event matter. They are found by a
    map-side combined aggregate, and the window sees at most one row per user and
    day, whatever a user's share of the events is.
    """
    days = timed.groupBy("user_id", "day").agg(
        F.min("et").alias("first_et"), F.max("et").alias("last_et")
    )
    by_day = Window.partitionBy("user_id").orderBy("day")
    silence = F.col("first_et") - F.lag("last_et").over(by_day)
    so_far = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return days.withColumn(
        "starts", F.coalesce(silence > MICROS_PER_DAY, F.lit(True))
    ).select(
        "user_id",
        "day",
        F.sum(F.col("starts").cast("int")).over(so_far).alias("sn"),
        F.max(F.when(F.col("starts"), F.col("first_et"))).over(so_far).alias("sstart"),
    )


def write_event_log(events: DataFrame, path: str) -> None:
    """Write the event log of the given events, partitioned by day."""
    event_log(events).write.mode("overwrite").partitionBy("event_date").parquet(path)


def _string_entry(key: str, value: Column) -> Column:
    filled = F.struct(value.alias("string_value"), F.lit(None).cast("long").alias("int_value"))
    return F.when(value.isNotNull(), F.struct(F.lit(key).alias("key"), filled.alias("value")))


def _int_entry(key: str, value: Column) -> Column:
    filled = F.struct(F.lit(None).cast("string").alias("string_value"), value.alias("int_value"))
    return F.when(value.isNotNull(), F.struct(F.lit(key).alias("key"), filled.alias("value")))


def event_log(events: DataFrame) -> DataFrame:
    """Nested event log rows in the schema of ``EVENT_SCHEMA``, brought together by day.

    The rebalance hint lets adaptive execution split a heavy day over several
    tasks and merge light ones, so files of the log stay even. It is placed before
    the rows are widened.
    """
    timed = timed_events(events)
    e = timed.join(session_days(timed), ["user_id", "day"]).hint("rebalance", "day")
    event_id, user_id, k = F.col("event_id"), F.col("user_id"), F.col("k")

    number = (
        F.when(event_id % 83 == 0, None)
        .when(event_id % 101 == 0, F.col("sn") + 1)
        .when(user_id % 50 == 49, F.col("sn") - 1)
        .when(user_id % 10 == 3, F.col("sn") + 1)
        .otherwise(F.col("sn"))
        .cast("long")
    )
    session = F.when(
        event_id % 89 != 0, ((F.col("sstart") - F.pmod("sstart", F.lit(1_000_000))) / 1_000_000).cast("long")
    )
    name = _first_match(
        [(F.col("event_type") == old, F.lit(new)) for old, new in EVENT_NAMES]
        + [(k % 3 == i, F.lit(new)) for i, new in enumerate(SIGNUP_NAMES)],
    )
    traffic = _first_match(
        [
            (
                k.between(low, high),
                F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(("source", "medium", "campaign"), values)]),
            )
            for low, high, *values in TRAFFIC
        ],
    )
    user_traffic = _first_match(
        [
            (
                user_id % 5 == rest,
                F.struct(*[F.lit(v).alias(n) for n, v in zip(("medium", "source", "name"), values)]),
            )
            for rest, *values in USER_TRAFFIC
        ],
    )
    no_traffic = F.struct(*[F.lit(None).cast("string").alias(n) for n in ("medium", "source", "name")])
    earns = ((F.col("event_type") == "purchase") & (k % 11 != 0)) | (
        (F.col("event_type") == "error") & (k == 7)
    )
    rows = e.withColumn("traffic", traffic).select(
        F.col("et").alias("event_timestamp"),
        name.alias("event_name"),
        F.when(event_id % 97 != 0, F.concat(F.lit("u"), user_id.cast("string"))).alias("user_pseudo_id"),
        F.array_compact(
            F.array(
                _int_entry("ga_session_id", session),
                _int_entry("ga_session_number", number),
                _string_entry("source", F.col("traffic.source")),
                _string_entry("medium", F.col("traffic.medium")),
                _string_entry("campaign", F.col("traffic.campaign")),
            )
        ).alias("event_params"),
        F.coalesce(user_traffic, no_traffic).alias("traffic_source"),
        F.struct(F.when(earns, F.col("value")).alias("purchase_revenue_in_usd")).alias("ecommerce"),
        F.date_format(F.date_from_unix_date("day"), "yyyyMMdd").alias("event_date"),
    )
    return rows.select(EVENT_SCHEMA.fieldNames())
