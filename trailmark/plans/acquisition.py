"""Where sessions come from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.channels import OTHER, channel_group, is_self_referral
from trailmark.functions.metrics import pct, rows
from trailmark.operators.shares import share_over_labels, share_over_values


def _sessions(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(*keys).agg(rows().alias("sessions"))


def by_source_medium(acquisition: DataFrame) -> DataFrame:
    grouped = _sessions(acquisition, "session_source", "session_medium")
    return share_over_values(grouped, "sessions", "session_share_pct").orderBy(F.desc("sessions"))


def self_referrals(acquisition: DataFrame) -> DataFrame:
    """Sessions referred by the own domains, counted against all in one pass."""
    own = F.count_if(is_self_referral())
    return acquisition.agg(
        own.alias("self_referral_sessions"),
        pct(own, rows()).alias("self_referral_session_share_pct"),
    )


def by_channel(acquisition: DataFrame) -> DataFrame:
    grouped = _sessions(acquisition, channel_group().alias("channel_group"))
    return share_over_labels(grouped, "sessions", "session_share_pct").orderBy(F.desc("sessions"))


def other_breakdown(acquisition: DataFrame) -> DataFrame:
    """Source and medium of the sessions no channel rule matches."""
    other = acquisition.filter(channel_group() == OTHER)
    grouped = _sessions(other, "session_source", "session_medium")
    return share_over_values(grouped, "sessions", "pct_within_other_channel").orderBy(
        F.desc("sessions")
    )
