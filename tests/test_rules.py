"""Rules on hand-made events."""

from __future__ import annotations

import datetime
from decimal import ROUND_HALF_UP, Decimal

import pytest
from event_rows import event, micros
from pyspark.sql import functions as F

from trailmark.functions.calendar import shard_day, utc_date, week_start
from trailmark.functions.channels import channel_group
from trailmark.functions.labels import frequency_group, frequency_rank, session_type
from trailmark.functions.metrics import cents, exact_sum, money_pct, money_per, pct, ratio
from trailmark.functions.params import event_param, session_key
from trailmark.operators.cohorts import (
    analysis_window,
    exact_day_retention,
    retention_rates,
    user_cohorts,
    user_session_dates,
)
from trailmark.operators.sessions import session_facts
from trailmark.plans import behaviour, checks, dashboards, models, performance, profiling, retention, traffic
from trailmark.sources.event_log import PERIOD_END, PERIOD_START, read_events, within_days


def final(events):
    return models.session_model_final(models.marketing_of(session_facts(events)))


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


# Parameters and keys.


def test_missing_parameter_is_null(log):
    row = one(log(event("2020-11-02 10:00:00")).select(event_param("source", "string_value").alias("v")))
    assert row["v"] is None


def test_repeated_parameter_takes_first_and_is_reported(log):
    events = log(
        event("2020-11-02 10:00:00", source="a", medium="m", extra=(("source", "b"),)),
        event("2020-11-02 10:01:00", source="c"),
    )
    first = events.select(event_param("source", "string_value").alias("v")).orderBy("v").collect()
    assert [r["v"] for r in first] == ["a", "c"]
    repeats = {r["param_key"]: r["events_with_repeats"] for r in profiling.duplicate_params(events).collect()}
    assert repeats["source"] == 1 and sum(repeats.values()) == 1


def test_parameter_of_null_list_is_null(spark):
    df = spark.createDataFrame(
        [(None,)], "event_params array<struct<key:string,value:struct<string_value:string,int_value:bigint>>>"
    )
    assert one(df.select(event_param("source", "string_value").alias("v")))["v"] is None


def test_session_key_is_null_with_a_null_part(spark):
    df = spark.createDataFrame(
        [("u", 5), (None, 5), ("u", None)], "user_pseudo_id string, ga_session_id bigint"
    )
    assert [r[0] for r in df.select(session_key()).collect()] == ["u-5", None, None]


def test_events_without_user_or_session_belong_to_no_session(log):
    events = log(
        event("2020-11-02 10:00:00"),
        event("2020-11-02 10:01:00", user=None),
        event("2020-11-02 10:02:00", session=None),
    )
    assert one(session_facts(events))["unique_session_id"] == "u1-1"


# Attribution.


def test_first_event_with_both_source_and_medium_counts(log):
    events = log(
        event("2020-11-02 10:00:00", source="solo"),
        event("2020-11-02 10:01:00", medium="organic", campaign="x"),
        event("2020-11-02 10:02:00", source="google", medium="cpc"),
        event("2020-11-02 10:03:00", source="later", medium="email", campaign="c"),
    )
    row = one(models.session_acquisition(events))
    assert (row["session_source"], row["session_medium"], row["session_campaign"]) == ("google", "cpc", None)
    assert row["first_traffic_event_timestamp"] == micros("2020-11-02 10:02:00")
    assert row["earliest_event_timestamp"] == micros("2020-11-02 10:00:00")


def test_tied_traffic_events_give_one_stable_row(log):
    rows = [
        event("2020-11-02 10:00:00", source="b", medium="m", campaign="z"),
        event("2020-11-02 10:00:00", source="a", medium="m", campaign="y"),
        event("2020-11-02 10:00:00", source="a", medium="m"),
    ]
    for order in (rows, rows[::-1]):
        row = one(models.session_acquisition(log(*order)))
        assert (row["session_source"], row["session_campaign"]) == ("a", None)


def test_session_never_naming_both_is_unattributed(log):
    events = log(
        event("2020-11-02 10:00:00", source="solo"), event("2020-11-02 10:01:00", medium="organic")
    )
    row = one(models.marketing_of(session_facts(events)))
    assert row["channel_group"] == "Unattributed" and row["session_source"] is None
    coverage = one(traffic.attribution_coverage(events))
    assert (coverage["total_sessions"], coverage["unattributed_sessions"]) == (1, 1)


# Sessions.


def test_conflicting_numbers_repeat_session_values(log):
    events = log(
        event("2020-11-02 10:00:00", number=1, name="purchase", revenue=10.0),
        event("2020-11-02 10:05:00", number=2, source="google", medium="cpc"),
        event("2020-11-02 10:06:00", number=None, revenue=2.5),
    )
    rows = {r["ga_session_number"]: r for r in session_facts(events).collect()}
    assert set(rows) == {1, 2, None}
    assert {r["session_revenue_usd"] for r in rows.values()} == {12.5}
    assert {r["purchase_flag"] for r in rows.values()} == {1}
    assert {r["session_source"] for r in rows.values()} == {"google"}
    assert rows[2]["earliest_event_timestamp"] == micros("2020-11-02 10:05:00")
    assert [r["row_count"] for r in checks.duplicate_sessions(final(events)).collect()] == [2]


def test_fused_and_joined_marketing_agree(log):
    events = log(
        event("2020-11-02 10:00:00", number=1, name="purchase", revenue=10.0),
        event("2020-11-02 10:05:00", number=2, source="google", medium="cpc"),
        event("2020-11-03 10:00:00", user="u2", session=7, name="view_item"),
    )
    fused = models.marketing_of(session_facts(events))
    joined = models.session_marketing_performance(
        models.session_acquisition(events), models.session_ecommerce_performance(events)
    )
    assert fused.columns == joined.columns
    assert sorted(map(str, fused.collect())) == sorted(map(str, joined.collect()))


def test_sessions_without_ecommerce_row_get_zeros(log):
    events = log(event("2020-11-02 10:00:00"))
    none = models.session_ecommerce_performance(events).filter("false")
    row = one(models.session_marketing_performance(models.session_acquisition(events), none))
    assert row["purchase_flag"] == 0 and row["session_revenue_usd"] == 0.0


def test_revenue_counts_all_events_and_defaults_to_zero(log):
    events = log(
        event("2020-11-02 10:00:00", session=1, name="page_view", revenue=3.0),
        event("2020-11-02 10:01:00", session=2, name="purchase"),
    )
    rows = {r["unique_session_id"]: r for r in models.session_ecommerce_performance(events).collect()}
    assert rows["u1-1"]["session_revenue_usd"] == 3.0 and rows["u1-1"]["purchase_flag"] == 0
    assert rows["u1-2"]["session_revenue_usd"] == 0.0 and rows["u1-2"]["purchase_flag"] == 1
    check = one(checks.revenue_consistency(final(events)))
    assert check["purchase_sessions_without_positive_revenue"] == 1
    assert check["non_purchase_sessions_with_revenue"] == 1


def test_session_over_midnight_belongs_to_its_first_day(log):
    events = log(event("2020-11-30 23:59:00"), event("2020-12-01 00:01:00"))
    row = one(final(events))
    assert row["session_date"] == datetime.date(2020, 11, 30)
    assert row["session_month"] == datetime.date(2020, 11, 1)


def test_days_are_utc_in_any_session_zone(spark, log):
    events = log(event("2020-11-30 23:59:00"), event("2020-11-30 00:01:00", session=2))
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("America/Los_Angeles", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            days = {r["session_date"] for r in final(events).collect()}
            assert days == {datetime.date(2020, 11, 30)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_day_before_epoch(spark):
    df = spark.createDataFrame([(-1,), (0,), (-86_400_000_001,)], "t bigint")
    days = [r[0] for r in df.select(utc_date("t")).collect()]
    assert days == [datetime.date(1969, 12, 31), datetime.date(1970, 1, 1), datetime.date(1969, 12, 30)]


def test_weeks_start_on_monday(spark):
    df = spark.createDataFrame([(datetime.date(2020, 11, 1),), (datetime.date(2020, 11, 2),)], "d date")
    weeks = [r[0] for r in df.select(week_start("d")).collect()]
    assert weeks == [datetime.date(2020, 10, 26), datetime.date(2020, 11, 2)]


def test_unreadable_day_is_null(spark):
    df = spark.createDataFrame([("20201101",), ("intraday",)], "d string")
    assert [r[0] for r in df.select(shard_day("d")).collect()] == [datetime.date(2020, 11, 1), None]


# Labels and rates.


@pytest.mark.parametrize(
    ("source", "medium", "label"),
    [
        (None, None, "Unattributed"),
        ("x.googlemerchandise.y", "referral", "Self-referral"),
        ("x.googlemerchandise.y", "organic", "Organic Search"),
        ("partner", "referral", "Referral"),
        (None, "referral", "Referral"),
        ("(direct)", "(none)", "Direct"),
        ("(direct)", "cpc", "Paid Search"),
        ("other", "(none)", "Other"),
        ("a", "Organic", "Other"),
        ("n", "email", "Email"),
        ("n", "affiliate", "Affiliate"),
        ("n", "(data deleted)", "Data Unavailable"),
        ("n", "<Other>", "Data Unavailable"),
        ("solo", None, "Other"),
        (None, "organic", "Organic Search"),
    ],
)
def test_channel_rules(spark, source, medium, label):
    df = spark.createDataFrame([(source, medium)], "session_source string, session_medium string")
    assert one(df.select(channel_group().alias("c")))["c"] == label


def test_session_types(spark):
    df = spark.createDataFrame([(1,), (2,), (0,), (None,)], "ga_session_number bigint")
    assert [r[0] for r in df.select(session_type()).collect()] == ["New", "Returning", None, None]
    assert [r[0] for r in df.select(session_type(unknown="Unknown")).collect()] == [
        "New", "Returning", "Unknown", "Unknown",
    ]


def test_frequency_groups(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (3,), (9,)], "purchase_count bigint")
    grouped = df.select(frequency_group().alias("frequency_group"))
    assert [r[0] for r in grouped.collect()] == [None, "1 Purchase", "2 Purchases", "3+ Purchases", "3+ Purchases"]
    assert [r[0] for r in grouped.na.drop().select(frequency_rank()).collect()] == [1, 2, 3, 3]


def test_rates_are_null_without_denominator(spark):
    df = spark.createDataFrame([(1, 0), (1, 8), (3, 2)], "a bigint, b bigint")
    assert [tuple(r) for r in df.select(pct("a", "b"), ratio("a", "b")).collect()] == [
        (None, None), (12.5, 0.13), (150.0, 1.5),
    ]


def test_unclassified_numbers(log):
    events = log(
        event("2020-11-02 10:00:00", session=1, number=0),
        event("2020-11-02 10:00:00", session=2, number=None),
        event("2020-11-02 10:00:00", session=3, number=1),
        event("2020-11-02 10:00:00", session=4, number=2),
    )
    marketing = models.marketing_of(session_facts(events))
    assert one(checks.unclassified_sessions(marketing))["unclassified_sessions"] == 2
    assert models.session_model_final(marketing).count() == 2
    # The funnel keeps number 0 as a group of its own and leaves out unknown numbers.
    funnel = {r["session_type"]: r["total_sessions"] for r in behaviour.new_vs_returning_funnel(events).collect()}
    assert funnel == {None: 1, "New": 1, "Returning": 1}


def test_small_sources_are_hidden_only_in_their_report(log):
    rows = [
        event("2020-11-02 10:00:00", session=i, source="big" if i < 3 else "small", medium="cpc")
        for i in range(5)
    ]
    marketing = models.marketing_of(session_facts(log(*rows)))
    assert performance.source_medium_performance(marketing).count() == 0
    report = performance.source_medium_performance(marketing, min_sessions=3).collect()
    assert [(r["session_source"], r["total_sessions"]) for r in report] == [("big", 3)]


def test_purchases_count_sessions_and_repeat_revenue(log):
    events = log(
        event("2020-11-02 10:00:00", number=1, name="purchase", revenue=4.0),
        event("2020-11-02 10:01:00", number=1, name="purchase", revenue=4.0),
        event("2020-11-02 10:02:00", number=2),
        event("2020-11-05 10:00:00", session=2, number=3, name="purchase", revenue=1.0),
    )
    row = one(models.user_purchase_frequency(final(events)))
    assert row["purchase_count"] == 2 and row["frequency_group"] == "2 Purchases"
    assert row["total_revenue_usd"] == 17.0
    assert (row["first_purchase_date"], row["last_purchase_date"]) == (
        datetime.date(2020, 11, 2), datetime.date(2020, 11, 5),
    )


# Days read.


def test_only_days_of_the_period_are_read(spark, log, tmp_path):
    days = ("20201031", "20201101", "20210131", "20210201")
    rows = [event("2020-11-02 10:00:00", day=day) for day in days]
    path = str(tmp_path / "log")
    log(*rows).write.partitionBy("event_date").parquet(path)
    read = read_events(spark, path, PERIOD_START, PERIOD_END)
    assert sorted(r["event_date"] for r in read.collect()) == ["20201101", "20210131"]
    assert dict(read.dtypes)["event_date"] == "string"
    assert read_events(spark, path, "20201031", "20201031").count() == 1
    assert within_days(log(*rows), PERIOD_START, PERIOD_END).count() == 2


# Retention.


def test_first_session_is_the_earliest_numbered_one(log):
    events = log(
        event("2020-11-04 10:00:00", session=9, source="google", medium="cpc"),
        event("2020-11-03 10:00:00", session=8, source="google", medium="organic"),
        event("2020-11-03 10:00:00", session=7, source="(direct)", medium="(none)"),
        event("2020-11-01 10:00:00", session=6, number=2),
        event("2020-11-01 10:00:00", user="u2", number=2),
    )
    row = one(user_cohorts(final(events)))
    assert row["first_session_date"] == datetime.date(2020, 11, 3)
    assert row["first_session_channel"] == "Direct"
    assert row["cohort_week"] == datetime.date(2020, 11, 2)


def _returning(log, days_back, last="2020-12-31"):
    """A user first seen on 2020-11-02 and again after each of ``days_back`` days."""
    first = datetime.date(2020, 11, 2)
    rows = [event(f"{first} 10:00:00", session=1)]
    rows += [
        event(f"{first + datetime.timedelta(days=d)} 09:00:00", session=10 + d, number=2)
        for d in days_back
    ]
    rows.append(event(f"{last} 10:00:00", user="end", number=2))
    return exact_day_retention(final(log(*rows)))


def test_only_the_exact_day_counts(log):
    row = one(_returning(log, (6, 8)))
    assert (row["d7_eligible"], row["d7_retained"]) == (1, 0)
    row = one(_returning(log, (7, 30)))
    assert (row["d7_retained"], row["d30_retained"]) == (1, 1)


def test_eligibility_ends_with_the_data(log):
    assert one(_returning(log, (), last="2020-11-09"))["d7_eligible"] == 1
    assert one(_returning(log, (), last="2020-11-08"))["d7_eligible"] == 0


def test_no_rate_without_eligible_users(log):
    rates = one(retention_rates(_returning(log, (7,), last="2020-11-20"), "cohort_week"))
    assert (rates["d7_retention_rate"], rates["d30_eligible_users"]) == (100.0, 0)
    assert rates["d30_retention_rate"] is None


def test_other_horizons(log):
    sessions = final(log(event("2020-11-02 10:00:00"), event("2020-11-03 10:00:00", session=2, number=2)))
    row = one(retention_rates(exact_day_retention(sessions, (1,)), "first_session_channel", (1,)))
    assert (row["d1_eligible_users"], row["d1_retained_users"], row["d1_retention_rate"]) == (1, 1, 100.0)


def test_retention_matches_brute_force(log):
    rows = []
    for u in range(40):
        for s in range(1 + u % 6):
            day = datetime.date(2020, 11, 1) + datetime.timedelta(days=u % 20 + s * (7, 11, 30)[u % 3])
            rows.append(event(f"{day} 10:00:00", user=f"u{u}", session=s, number=s + 1 + (u % 7 == 6)))
    sessions = final(log(*rows))
    dates = {(r[0], r[1]) for r in user_session_dates(sessions).collect()}
    last = one(analysis_window(sessions))["max_session_date"]
    expected = {}
    for r in user_cohorts(sessions).collect():
        flags = []
        for n in (7, 30):
            step = datetime.timedelta(days=n)
            eligible = r["first_session_date"] + step <= last
            flags += [int(eligible), int(eligible and (r["user_pseudo_id"], r["first_session_date"] + step) in dates)]
        expected[r["user_pseudo_id"]] = tuple(flags)
    actual = {
        r["user_pseudo_id"]: (r["d7_eligible"], r["d7_retained"], r["d30_eligible"], r["d30_retained"])
        for r in exact_day_retention(sessions).collect()
    }
    assert actual == expected
    assert any(f[1] for f in expected.values()) and any(f[3] for f in expected.values())


def test_broken_cohort_rows_are_found(spark):
    good = spark.createDataFrame([(3, 2, 1, 2, 0)], "cohort_size bigint, d7_eligible_users bigint, "
        "d7_retained_users bigint, d30_eligible_users bigint, d30_retained_users bigint")
    bad = good.withColumn("d30_retained_users", F.lit(5).cast("bigint"))
    found = {r["model"]: r["invalid_rows"] for r in retention.impossible_counts(good, bad).collect()}
    assert found == {"Weekly Cohort": 0, "Channel Retention": 1}
    match = one(retention.reconcile(good, bad))
    assert match["cohort_users_match"] and not match["d30_retained_match"]
    assert (match["weekly_d30_retained"], match["channel_d30_retained"]) == (0, 5)


# Dashboard filters.


def test_kpis_of_a_selection(log):
    events = log(
        event("2020-11-02 10:00:00", user="a", session=1, source="(direct)", medium="(none)", name="purchase", revenue=5.0),
        event("2020-11-03 10:00:00", user="a", session=2, source="(direct)", medium="(none)"),
        event("2020-11-04 10:00:00", user="b", session=3),
    )
    sessions = final(events)
    whole = one(dashboards.kpi_summary(sessions))
    assert (whole["users"], whole["sessions"], whole["revenue_usd"], whole["conversion_rate"]) == (2, 3, 5.0, 33.33)
    part = one(dashboards.kpi_summary(sessions, "2020-11-03", "2020-11-04", ["Direct"]))
    assert (part["users"], part["sessions"], part["revenue_usd"]) == (1, 1, 0.0)
    none = one(dashboards.kpi_summary(sessions, "2030-01-01"))
    assert (none["users"], none["sessions"], none["conversion_rate"]) == (0, 0, None)


# Empty input.


def test_empty_log(log):
    events = log()
    facts = session_facts(events)
    marketing = models.marketing_of(facts)
    sessions = models.session_model_final(marketing)
    purchasers = models.user_purchase_frequency(sessions)
    users = exact_day_retention(sessions)
    weekly = retention_rates(users, "cohort_week")
    assert one(profiling.dataset_profile(events))["total_events"] == 0
    assert one(profiling.session_id_completeness(events))["session_id_completeness_pct"] is None
    assert one(profiling.volumes(events))["total_events"] == 0
    assert one(profiling.sessions_per_user(events))["average_sessions_per_user"] is None
    assert one(traffic.cooccurrence(events))["events_with_all_three"] == 0
    assert one(traffic.attribution_coverage(events))["attributed_sessions_pct"] is None
    assert performance.channel_revenue(marketing).count() == 0
    assert performance.campaign_distribution(marketing).count() == 0
    assert one(checks.flag_domain(marketing))["max_purchase_flag"] is None
    assert one(checks.purchases_missing_stages(marketing))["purchases_without_view_item"] == 0
    assert one(checks.revenue_consistency(sessions))["total_revenue_usd"] is None
    assert one(checks.repeat_purchaser_rate(purchasers))["repeat_purchaser_rate"] is None
    assert one(retention.totals(weekly))["overall_d7_retention_rate"] is None
    assert one(dashboards.kpi_summary(sessions))["sessions"] == 0


def test_rates_round_exactly_and_halves_away_from_zero(spark):
    cases = [(201, 20_000), (1, 3), (2, 3), (1, 800), (137, 4000), (0, 5), (10**15 + 5, 2 * 10**19 // 10)]
    df = spark.createDataFrame(cases, "a bigint, b bigint")
    found = [tuple(r) for r in df.select(pct("a", "b"), ratio("a", "b")).collect()]
    half_up = lambda a, b, k: float((Decimal(k * a) / b).quantize(Decimal("0.01"), ROUND_HALF_UP))
    assert found == [(half_up(a, b, 100), half_up(a, b, 1)) for a, b in cases]
    # 1.005 is stored below itself; exactly it is a half.
    assert found[0] == (1.01, 0.01)


def test_money_rounds_exactly_at_any_size(spark):
    rows = [("34.285", 1), ("-34.285", 1), ("1000000000000000.005", 1), ("10.000000", 10**13), ("68.57", 2), ("1", 0)]
    df = spark.createDataFrame(rows, "m string, n bigint").withColumn("m", F.col("m").cast("decimal(38,6)"))
    assert [r[0] for r in df.select(money_per("m", "n")).collect()] == [
        34.29, -34.29, 1000000000000000.0, 0.0, 34.29, None,
    ]
    total = spark.range(1000).select(F.lit(5e12).alias("x")).agg(exact_sum("x").alias("x"))
    assert total.select(cents("x"), money_pct("x", "x")).first() == (5e15, 100.0)
