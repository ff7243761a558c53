"""Marketing channel of a source and medium."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Channel labels with the traffic values that select them. The first
# match decides, and matching is case-sensitive.
UNATTRIBUTED = "Unattributed"
SELF_REFERRAL = "Self-referral"
DIRECT = "Direct"
DATA_UNAVAILABLE = "Data Unavailable"
OTHER = "Other"
OWN_DOMAIN_PATTERN = "%googlemerchandise%"
DIRECT_TRAFFIC = ("(direct)", "(none)")
MEDIUM_CHANNELS = (
    ("organic", "Organic Search"),
    ("cpc", "Paid Search"),
    ("email", "Email"),
    ("affiliate", "Affiliate"),
    ("referral", "Referral"),
    ("(data deleted)", DATA_UNAVAILABLE),
    ("<Other>", DATA_UNAVAILABLE),
)


def is_self_referral(
    source: str = "session_source",
    medium: str = "session_medium",
    own_domain: str = OWN_DOMAIN_PATTERN,
) -> Column:
    return F.col(source).like(own_domain) & (F.col(medium) == "referral")


def channel_group(
    source: str = "session_source",
    medium: str = "session_medium",
    own_domain: str = OWN_DOMAIN_PATTERN,
    medium_channels: Sequence[tuple[str, str]] = MEDIUM_CHANNELS,
) -> Column:
    """Label of the first rule that matches, ``Other`` if none does."""
    src, med = F.col(source), F.col(medium)
    label = (
        F.when(src.isNull() & med.isNull(), UNATTRIBUTED)
        .when(is_self_referral(source, medium, own_domain), SELF_REFERRAL)
        .when((src == DIRECT_TRAFFIC[0]) & (med == DIRECT_TRAFFIC[1]), DIRECT)
    )
    for value, name in medium_channels:
        label = label.when(med == value, name)
    return label.otherwise(OTHER)
