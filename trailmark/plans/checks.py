"""Data-quality checks. They point at unexpected patterns, which need not be errors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.labels import UNKNOWN, session_type
from trailmark.functions.metrics import cents, exact_sum, missing, pct, rows
from trailmark.operators.sessions import SESSION_KEYS, STAGES, flag, has_traffic
from trailmark.operators.shares import share_over_labels
from trailmark.rules import DEFAULT, Rules


def duplicate_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions with several rows. Expected: none."""
    return (
        sessions.groupBy("unique_session_id")
        .agg(rows().alias("row_count"))
        .filter(F.col("row_count") > 1)
        .orderBy(F.desc("row_count"))
    )


def missing_ids(marketing: DataFrame) -> DataFrame:
    # Report names of the four identifiers.
    names = ("unique_session_id", "user_id", "ga_session_id", "ga_session_number")
    return marketing.agg(
        rows().alias("total_sessions"),
        *[
            missing(column).alias(f"sessions_missing_{name}")
            for column, name in zip(SESSION_KEYS, names)
        ],
    )


def model_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and distinct sessions of each session table."""
    counts = [
        table.agg(
            rows().alias("rows"),
            F.count_distinct("unique_session_id").alias("distinct_sessions"),
        ).select(F.lit(name).alias("table_name"), "rows", "distinct_sessions")
        for name, table in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def session_type_split(sessions: DataFrame) -> DataFrame:
    grouped = sessions.groupBy("session_type").agg(rows().alias("sessions"))
    return share_over_labels(grouped, "sessions", "session_share_pct").orderBy(F.desc("sessions"))


def unclassified_sessions(marketing: DataFrame) -> DataFrame:
    """Sessions the final table leaves out."""
    number = F.col("ga_session_number")
    return marketing.filter(number.isNull() | (number < 1)).agg(
        rows().alias("unclassified_sessions")
    )


def flag_domain(marketing: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """Least and greatest value of each flag. Expected: within 0 and 1."""
    # Report names of the flags.
    names = ("view_item_flag", "add_to_cart_flag", "begin_checkout_flag",
             "shipping_flag", "payment_flag", "purchase_flag")
    return marketing.agg(
        *[
            bound(flag(stage)).alias(f"{bound.__name__}_{dict(zip(STAGES, names)).get(stage, flag(stage))}")
            for stage in stages
            for bound in (F.min, F.max)
        ]
    )


def purchases_missing_stages(marketing: DataFrame) -> DataFrame:
    """Purchasing sessions that lack an earlier stage, per stage."""
    # Report names of the stages before the purchase.
    names = ("view_item", "add_to_cart", "begin_checkout", "shipping_info", "payment_info")
    lacks = {name: F.col(flag(stage)) == 0 for name, stage in zip(names, STAGES)}
    return marketing.filter(F.col("purchase_flag") == 1).agg(
        *[F.count_if(lack).alias(f"purchases_without_{name}") for name, lack in lacks.items()],
        F.count_if(lacks["shipping_info"] | lacks["payment_info"]).alias(
            "purchases_missing_shipping_or_payment"
        ),
    )


def no_cart_purchases_by_type(marketing: DataFrame) -> DataFrame:
    name = "purchase_sessions_without_add_to_cart"
    return (
        marketing.filter((F.col("purchase_flag") == 1) & (F.col("add_to_cart_flag") == 0))
        .groupBy(session_type(unknown=UNKNOWN).alias("session_type"))
        .agg(rows().alias(name))
        .orderBy(F.desc(name))
    )


def purchases_by_type(marketing: DataFrame) -> DataFrame:
    grouped = (
        marketing.filter(F.col("purchase_flag") == 1)
        .groupBy(session_type(unknown=UNKNOWN).alias("session_type"))
        .agg(rows().alias("purchase_sessions"))
    )
    return share_over_labels(grouped, "purchase_sessions", "purchase_session_share_pct").orderBy(
        F.desc("purchase_sessions")
    )


def revenue_consistency(sessions: DataFrame) -> DataFrame:
    """Purchases without revenue and revenue without purchase."""
    bought, revenue = F.col("purchase_flag"), F.col("session_revenue_usd")
    return sessions.agg(
        rows().alias("total_sessions"),
        F.count_if((bought == 1) & (revenue <= 0)).alias("purchase_sessions_without_positive_revenue"),
        F.count_if((bought == 0) & (revenue > 0)).alias("non_purchase_sessions_with_revenue"),
        cents(exact_sum("session_revenue_usd")).alias("total_revenue_usd"),
    )


def attribution_completeness(marketing: DataFrame) -> DataFrame:
    attributed = F.count_if(has_traffic("session_source", "session_medium"))
    return marketing.agg(
        rows().alias("total_sessions"),
        attributed.alias("attributed_sessions"),
        (rows() - attributed).alias("sessions_with_incomplete_attribution"),
        pct(attributed, rows()).alias("attributed_session_pct"),
    )


def purchase_frequency_distribution(
    purchasers: DataFrame, rules: Rules = DEFAULT
) -> DataFrame:
    """Purchasers and share per segment, in segment order."""
    grouped = purchasers.groupBy("frequency_group").agg(rows().alias("purchasers"))
    return share_over_labels(grouped, "purchasers", "purchaser_share_pct").orderBy(
        rules.segment_rank()
    )


def repeat_purchase_overview(purchasers: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Purchasers and share per segment, each row with the repeat rate of all purchasers."""
    grouped = purchasers.groupBy("frequency_group").agg(
        rows().alias("purchasers"), F.count_if(F.col("purchase_count") >= 2).alias("repeated")
    )
    all_groups = Window.partitionBy()
    rate = pct(F.sum("repeated").over(all_groups), F.sum("purchasers").over(all_groups))
    shared = share_over_labels(grouped, "purchasers", "purchaser_share_pct")
    return (
        shared.withColumn("repeat_purchaser_rate", rate).drop("repeated").orderBy(
        rules.segment_rank()
    )
    )


def repeat_purchaser_rate(purchasers: DataFrame) -> DataFrame:
    repeat = F.count_if(F.col("purchase_count") >= 2)
    once = F.count_if(F.col("purchase_count") == 1)
    return purchasers.agg(
        rows().alias("total_purchasers"),
        repeat.alias("repeat_purchasers"),
        once.alias("one_time_purchasers"),
        pct(repeat, rows()).alias("repeat_purchaser_rate"),
        pct(once, rows()).alias("one_time_purchaser_rate"),
    )
