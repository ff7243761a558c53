"""User cohorts and exact-day retention over the final session table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.calendar import week_start
from trailmark.functions.metrics import pct, rows
from trailmark.operators.sessions import first_where

# Days after the first session at which a return is measured.
HORIZONS = (7, 30)

#: Days that one number of a user's calendar holds, one a bit.
_DAYS = 64


def analysis_window(sessions: DataFrame) -> DataFrame:
    """One row: the last observed session date."""
    return sessions.agg(F.max("session_date").alias("max_session_date"))


def user_session_dates(sessions: DataFrame) -> DataFrame:
    """Distinct (user, day) pairs."""
    return sessions.select("user_pseudo_id", "session_date").distinct()


def _first_session() -> Column:
    return first_where(
        F.col("ga_session_number") == 1,
        "session_timestamp",
        "unique_session_id",
        "session_date",
        "channel_group",
    )


def _cohort_columns() -> list[Column]:
    return [
        F.col("first_session.session_date").alias("first_session_date"),
        week_start("first_session.session_date").alias("cohort_week"),
        F.col("first_session.channel_group").alias("first_session_channel"),
    ]


def user_cohorts(sessions: DataFrame) -> DataFrame:
    """Day, Monday week and channel of each user's first session.

    The first session is the earliest one numbered 1, by time and then session id;
    users never seen with number 1 have no cohort.
    """
    return (
        sessions.filter(F.col("ga_session_number") == 1)
        .groupBy("user_pseudo_id")
        .agg(_first_session().alias("first_session"))
        .select("user_pseudo_id", *_cohort_columns())
    )


def user_calendars(sessions: DataFrame) -> DataFrame:
    """Per user of a cohort: day, week and channel of the first session, and the days with sessions as a bitmap.

    ``calendar`` is an array of 64-bit numbers, bit 0 of the first being the first day of the data, ``log_start``;
    ``log_end`` is the last one. From these rows any horizon can be read, see :func:`with_horizons`.

    One aggregate per user, so there is one shuffle and no join. Its buffer has a fixed width, a bit for each calendar
    day of the data, however many sessions a user has, and rows are combined on the map side. How wide it is follows
    from the first and the last day, which a small job reads first.
    """
    span = sessions.agg(F.min("session_date").alias("a"), F.max("session_date").alias("b")).first()
    days = (span["b"] - span["a"]).days + 1 if span["a"] else 1
    place = F.datediff("session_date", F.lit(span["a"]).cast("date"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(_DAYS)))
    words = [
        F.bit_or(F.when(place.between(_DAYS * i, _DAYS * i + _DAYS - 1), bit)).alias(f"word_{i}")
        for i in range(-(-days // _DAYS))
    ]
    per_user = (
        sessions.groupBy("user_pseudo_id")
        .agg(_first_session().alias("first_session"), *words)
        .filter(F.col("first_session").isNotNull())
    )
    calendar = [F.coalesce(f"word_{i}", F.lit(0).cast("long")) for i in range(len(words))]
    return per_user.select(
        "user_pseudo_id",
        *_cohort_columns(),
        F.array(*calendar).alias("calendar"),
        F.lit(span["a"]).cast("date").alias("log_start"),
        F.lit(span["b"]).cast("date").alias("log_end"),
    )


def with_horizons(calendars: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Per user of :func:`user_calendars`: eligible and retained flags (0/1) for each horizon.

    A user is eligible for day n if the data reaches n days past the first session,
    and retained if eligible and seen on exactly that day.
    """
    first = F.col("first_session_date")
    flags = []
    for n in horizons:
        eligible = F.date_add(first, n) <= F.col("log_end")
        place = F.datediff(F.date_add(first, n), "log_start")
        word = F.get("calendar", F.call_function("div", place, F.lit(_DAYS)).cast("int"))
        seen = F.call_function("shiftrightunsigned", word, F.pmod(place, F.lit(_DAYS))).bitwiseAND(F.lit(1)) == 1
        flags.append(eligible.cast("int").alias(f"d{n}_eligible"))
        flags.append((eligible & seen).cast("int").alias(f"d{n}_retained"))
    return calendars.select(
        "user_pseudo_id", "first_session_date", "cohort_week", "first_session_channel", *flags
    )


def exact_day_retention(sessions: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Flags of :func:`with_horizons` straight from the sessions."""
    return with_horizons(user_calendars(sessions), horizons)


def retention_long(
    users: DataFrame, key: Column | str, horizons: Sequence[int] = HORIZONS
) -> DataFrame:
    """Per ``key`` and horizon: cohort size, eligible and retained users. ``horizon`` counts days."""
    sums = [
        F.sum(f"d{n}_{state}").alias(f"d{n}_{state}")
        for n in horizons
        for state in ("eligible", "retained")
    ]
    cohorts = users.groupBy(key).agg(rows().alias("cohort_size"), *sums)
    name = cohorts.columns[0]
    measures = [
        F.struct(
            F.lit(n).alias("horizon"),
            F.col(f"d{n}_eligible").alias("eligible_users"),
            F.col(f"d{n}_retained").alias("retained_users"),
        )
        for n in horizons
    ]
    return cohorts.select(name, "cohort_size", F.explode(F.array(*measures)).alias("m")).select(
        name, "cohort_size", "m.*"
    )


def retention_wide(long: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Rows of :func:`retention_long` side by side: counts and rate of each of the ``horizons`` per cohort.

    No rate without eligible users. Horizons that the rows lack are NULL.
    """
    key = long.columns[0]
    counts = [
        F.max(F.when(F.col("horizon") == n, F.col(f"{state}_users"))).alias(f"d{n}_{state}_users")
        for n in horizons
        for state in ("eligible", "retained")
    ]
    wide = long.groupBy(key, "cohort_size").agg(*counts)
    measures = []
    for n in horizons:
        eligible, retained = f"d{n}_eligible_users", f"d{n}_retained_users"
        measures += [eligible, retained, pct(retained, eligible).alias(f"d{n}_retention_rate")]
    return wide.select(key, "cohort_size", *measures)


def retention_rates(
    users: DataFrame, key: Column | str, horizons: Sequence[int] = HORIZONS
) -> DataFrame:
    """Cohort size, eligible, retained and rate per ``key``; no rate without eligible users."""
    return retention_wide(retention_long(users, key, horizons), horizons)
