"""Funnel of new and returning sessions, straight from the events."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.labels import session_type
from trailmark.functions.metrics import pct, rows
from trailmark.operators.sessions import STAGES, flag, identified, stage_flags

# Report names of the stages, and of the steps between them.
STAGE_NAMES = ("view_item", "add_to_cart", "checkout", "shipping_info", "payment_info", "purchase")
STEP_NAMES = ("view", "cart", "checkout", "shipping", "payment", "purchase")


def new_vs_returning_funnel(events: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """Sessions, stage counts, stage rates and step rates per session type.

    Sessions count per session number; those without a number are left out, those
    with a number below 1 form the group without a type. Stages without a report
    name of their own are called by their event.
    """
    names = [dict(zip(STAGES, STAGE_NAMES)).get(stage, stage) for stage in stages]
    step_names = [dict(zip(STAGES, STEP_NAMES)).get(stage, stage) for stage in stages]
    sessions = (
        identified(events)
        .filter(F.col("ga_session_number").isNotNull())
        .groupBy("ga_session_id", "user_pseudo_id", "ga_session_number")
        .agg(*stage_flags(stages))
    )
    counts = sessions.groupBy(session_type().alias("session_type")).agg(
        rows().alias("total_sessions"),
        *[
            F.sum(flag(stage)).alias(f"{name}_sessions")
            for stage, name in zip(stages, names)
        ],
    )
    steps = zip(pairwise(names), pairwise(step_names))
    return counts.select(
        "*",
        *[pct(f"{name}_sessions", "total_sessions").alias(f"{name}_rate") for name in names],
        *[
            pct(f"{after}_sessions", f"{before}_sessions").alias(f"{start}_to_{end}_pct")
            for (before, after), (start, end) in steps
        ],
    ).orderBy("session_type")
