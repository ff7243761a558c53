"""Commercial results by channel, source and campaign."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.channels import DATA_UNAVAILABLE, SELF_REFERRAL, UNATTRIBUTED
from trailmark.functions.metrics import cents, exact_sum, money_per, pct, rows
from trailmark.operators.sessions import STAGES, flag
from trailmark.operators.shares import money_share_over_labels, share_over_values

# Report names of the stages (counts, rates), and what reports leave out.
COUNT_NAMES = (
    "product_view", "add_to_cart", "checkout", "shipping_info", "payment_info", "purchase",
)
RATE_NAMES = (
    "product_view_rate", "add_to_cart_rate", "checkout_rate", "shipping_info_rate",
    "payment_info_rate", "purchase_session_rate",
)
UNRELIABLE_CHANNELS = (SELF_REFERRAL, UNATTRIBUTED, DATA_UNAVAILABLE)
UNRELIABLE_SOURCES = ("<Other>", "(data deleted)")
GENERIC_CAMPAIGNS = ("(organic)", "(referral)", "(direct)", "<Other>", "(data deleted)")
MIN_SESSIONS = 100


def channel_funnel(marketing: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """Stage counts and rates per channel. Stages without a report name are called by their event."""
    count_names = [dict(zip(STAGES, COUNT_NAMES)).get(stage, stage) for stage in stages]
    rate_names = [dict(zip(STAGES, RATE_NAMES)).get(stage, f"{stage}_rate") for stage in stages]
    counts = marketing.groupBy("channel_group").agg(
        rows().alias("total_sessions"),
        *[
            F.sum(flag(stage)).alias(f"{name}_sessions")
            for stage, name in zip(stages, count_names)
        ],
    )
    rates = [
        pct(f"{name}_sessions", "total_sessions").alias(rate)
        for name, rate in zip(count_names, rate_names)
    ]
    return counts.select("*", *rates).orderBy(F.desc("purchase_session_rate"))


def value_totals(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Sessions, purchasing sessions and exact revenue per group."""
    return df.groupBy(*keys).agg(
        rows().alias("total_sessions"),
        F.sum("purchase_flag").alias("purchase_sessions"),
        exact_sum("session_revenue_usd").alias("revenue"),
    )


def value_measures() -> list[Column]:
    """Rounded measures over :func:`value_totals`."""
    return [
        "total_sessions",
        "purchase_sessions",
        cents("revenue").alias("total_revenue_usd"),
        pct("purchase_sessions", "total_sessions").alias("purchase_session_rate"),
        money_per("revenue", "total_sessions").alias("revenue_per_session_usd"),
        money_per("revenue", "purchase_sessions").alias("avg_revenue_per_purchasing_session_usd"),
    ]


def channel_revenue(marketing: DataFrame) -> DataFrame:
    totals = money_share_over_labels(
        value_totals(marketing, "channel_group"), "revenue", "revenue_share_pct"
    )
    return totals.select("channel_group", *value_measures(), "revenue_share_pct").orderBy(
        F.desc("total_revenue_usd")
    )


def source_medium_performance(
    marketing: DataFrame,
    min_sessions: int = MIN_SESSIONS,
    channels: Sequence[str] = UNRELIABLE_CHANNELS,
    sources: Sequence[str] = UNRELIABLE_SOURCES,
) -> DataFrame:
    """Value per source and medium, without unreliable traffic and small groups."""
    usable = marketing.filter(
        ~F.col("channel_group").isin(*channels)
        & F.col("session_medium").isNotNull()
        & ~F.col("session_source").isin(*sources)
    )
    totals = value_totals(usable, "session_source", "session_medium").filter(
        F.col("total_sessions") >= min_sessions
    )
    return totals.select("session_source", "session_medium", *value_measures()).orderBy(
        F.desc("total_revenue_usd")
    )


def campaign_distribution(marketing: DataFrame) -> DataFrame:
    grouped = marketing.groupBy("session_campaign").agg(rows().alias("total_sessions"))
    return share_over_values(grouped, "total_sessions", "session_share_pct").orderBy(
        F.desc("total_sessions")
    )


def named_campaigns(
    marketing: DataFrame, generic: Sequence[str] = GENERIC_CAMPAIGNS
) -> DataFrame:
    """Value per named campaign and its source and medium."""
    keys = ("session_campaign", "session_source", "session_medium")
    named = marketing.filter(~F.col("session_campaign").isin(*generic))
    return value_totals(named, *keys).select(*keys, *value_measures()).orderBy(
        F.desc("total_revenue_usd")
    )
