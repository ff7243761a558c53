"""The test event log made from the driver's events."""

from __future__ import annotations

from collections import defaultdict

import pytest
from event_rows import SF_DIR
from pyspark.sql import functions as F

from testbed.event_log import event_log, session_days, timed_events
from trailmark.functions.calendar import MICROS_PER_DAY
from trailmark.sources.event_log import EVENT_SCHEMA


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF_DIR}/events.parquet")


def test_every_event_is_kept_within_the_period(given):
    log = event_log(given)
    assert log.count() == given.count()
    days = log.agg(F.min("event_date"), F.max("event_date")).first()
    assert "20201101" <= days[0] and days[1] <= "20210131"


def test_columns_and_types(given):
    log = event_log(given)
    assert [(f.name, f.dataType.simpleString()) for f in log.schema] == [
        (f.name, f.dataType.simpleString()) for f in EVENT_SCHEMA
    ]


def brute_force(events):
    """(user, day) -> (number, start), event by event."""
    by_user = defaultdict(list)
    for row in events:
        by_user[row["user_id"]].append(row["et"])
    expected = {}
    for user, times in by_user.items():
        number, start, last = 0, None, None
        for t in sorted(times):
            if last is None or t - last > MICROS_PER_DAY:
                number, start = number + 1, t
            last = t
            expected[user, t // MICROS_PER_DAY] = (number, start)
    return expected


def test_daily_sessions_equal_event_level_sessions(given):
    timed = timed_events(given)
    actual = {
        (r["user_id"], r["day"]): (r["sn"], r["sstart"]) for r in session_days(timed).collect()
    }
    assert actual == brute_force(timed.select("user_id", "et").collect())


def test_break_is_more_than_a_day(spark):
    day = MICROS_PER_DAY
    times = [0, day, 2 * day + 1, 2 * day + 2, 3 * day + 2, 5 * day]
    timed = spark.createDataFrame([(1, t, t // day) for t in times], "user_id long, et long, day int")
    actual = {r["day"]: (r["sn"], r["sstart"]) for r in session_days(timed).collect()}
    assert actual == {0: (1, 0), 1: (1, 0), 2: (2, 2 * day + 1), 3: (2, 2 * day + 1), 5: (3, 5 * day)}


def test_other_session_zone_changes_nothing(spark, given):
    before = spark.conf.get("spark.sql.session.timeZone")
    expected = {tuple(r) for r in timed_events(given).select("event_id", "et").collect()}
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert {tuple(r) for r in timed_events(given).select("event_id", "et").collect()} == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
