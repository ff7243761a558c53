"""Other horizons, channels, stages and segments reach every table and report, each against its own SQL."""

from __future__ import annotations

import pytest
from event_rows import SF_DIR

from oracle import tables
from oracle.compare import connect, difference
from oracle.statements import all_statements
from testbed import store
from trailmark.operators import cohorts
from trailmark.plans import acquisition, behaviour, checks, dashboards, performance, retention
from trailmark.rules import Rules
from trailmark.workspace import Workspace

HORIZONS = (1, 14, 45)
OTHER = Rules(
    own_domain="%partner%",
    medium_channels=(("organic", "Search"), ("cpc", "Search"), ("video", "Video"), ("referral", "Links")),
    stages=("add_to_cart", "begin_checkout", "purchase"),
    frequency_bands=((1, "once"), (2, "2-4"), (5, "often")),
    horizons=HORIZONS,
)
STATEMENTS = all_statements(
    horizons=HORIZONS,
    own_domain="partner",
    mediums=OTHER.medium_channels,
    stages=OTHER.stages,
    bands=OTHER.frequency_bands,
)


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.fixture(scope="module")
def ws(spark, tmp_path_factory):
    events = store.workspace(spark, SF_DIR).events
    return Workspace(events, str(tmp_path_factory.mktemp("other")), OTHER)


REPORTS = {
    "weekly_cohort_retention": lambda ws: ws.weekly_retention(),
    "channel_retention": lambda ws: ws.channel_retention(),
    "retention_totals_weekly": lambda ws: retention.totals(ws.weekly_retention(), HORIZONS),
    "retention_totals_channel": lambda ws: retention.totals(ws.channel_retention(), HORIZONS),
    "retention_reconcile": lambda ws: retention.reconcile(ws.weekly_retention(), ws.channel_retention(), HORIZONS),
    "retention_review_channel": lambda ws: retention.review_channel(ws.channel_retention(), HORIZONS),
    "retention_review_weekly": lambda ws: retention.review_weekly(ws.weekly_retention(), HORIZONS),
    "check_impossible_retention": lambda ws: retention.impossible_counts(
        ws.weekly_retention(), ws.channel_retention(), HORIZONS
    ),
    "cohort_eligibility": lambda ws: retention.cohort_eligibility(ws.weekly_retention(), HORIZONS),
    "cohort_matrix": lambda ws: retention.cohort_matrix(ws.weekly_retention_long()),
    "exact_day_retention": lambda ws: ws.retention_users(),
    "user_purchase_frequency": lambda ws: ws.purchasers(),
    "purchase_frequency_distribution": lambda ws: checks.purchase_frequency_distribution(ws.purchasers(), OTHER),
    "repeat_purchase_overview": lambda ws: checks.repeat_purchase_overview(ws.purchasers(), OTHER),
    "channel_revenue": lambda ws: performance.channel_revenue(ws.marketing()),
    "channel_overview": lambda ws: dashboards.channel_overview(ws.sessions()),
    "check_purchases_by_type": lambda ws: checks.purchases_by_type(ws.marketing()),
}


@pytest.mark.parametrize("name", REPORTS)
def test_report_with_other_rules(ws, con, name):
    assert difference(REPORTS[name](ws), con, STATEMENTS[name]) is None


def test_other_rules_change_the_rows(ws):
    channels = {r[0] for r in ws.marketing().select("channel_group").distinct().collect()}
    assert {"Search", "Video", "Links", "Self-referral"} <= channels and "Email" not in channels
    segments = {r[0] for r in ws.purchasers().select("frequency_group").distinct().collect()}
    assert segments <= {"once", "2-4", "often"} and len(segments) > 1


def prefix() -> str:
    return tables.prefix(horizons=HORIZONS, mediums=OTHER.medium_channels, own_domain="partner", stages=OTHER.stages)


def test_tables_hold_the_chosen_stages(ws, con):
    flags = ", ".join(f"{s}_flag" for s in OTHER.stages)
    sql = f"{prefix()}SELECT unique_session_id, {flags}, session_revenue_usd FROM ecommerce"
    assert difference(ws.ecommerce(), con, sql) is None
    assert [c for c in ws.sessions().columns if c.endswith("_flag")] == [f"{s}_flag" for s in OTHER.stages]
    joined = ws.joined_marketing()
    assert joined.columns == ws.marketing().columns
    assert sorted(map(str, joined.collect())) == sorted(map(str, ws.marketing().collect()))


def test_funnels_of_the_chosen_stages(ws):
    funnel = performance.channel_funnel(ws.marketing(), OTHER.stages)
    assert [c for c in funnel.columns if c.endswith("_sessions")] == [
        "total_sessions", "add_to_cart_sessions", "checkout_sessions", "purchase_sessions",
    ]
    assert funnel.agg({"total_sessions": "sum"}).first()[0] == ws.marketing().count()
    by_type = behaviour.new_vs_returning_funnel(ws.events(), OTHER.stages)
    assert [c for c in by_type.columns if c.endswith("_pct")] == ["cart_to_checkout_pct", "checkout_to_purchase_pct"]
    from_first = dashboards.user_type_funnel_from_view(ws.sessions(), OTHER.stages)
    assert from_first.columns[2:4] == ["begin_checkout_sessions", "purchase_sessions"]
    assert checks.flag_domain(ws.marketing(), OTHER.stages).first().asDict().keys() == {
        f"{b}_{s}_flag" for s in OTHER.stages for b in ("min", "max")
    }


def test_any_horizon_is_read_from_the_stored_days(spark, con):
    ws = store.workspace(spark, SF_DIR)
    for horizons in ((0,), (3, 60), (5, 64, 89)):
        users = ws.retention_users(horizons)
        sql = f"{tables.prefix(horizons=horizons)}SELECT * FROM retained"
        assert difference(users, con, sql) is None
        long = cohorts.retention_long(users, "cohort_week", horizons)
        assert long.columns == ["cohort_week", "cohort_size", "horizon", "eligible_users", "retained_users"]
        wide = cohorts.retention_wide(long, horizons)
        assert difference(wide, con, all_statements(horizons=horizons)["weekly_cohort_retention"]) is None


@pytest.mark.parametrize(
    "wrong",
    [{"stages": ("view_item",)}, {"horizons": ()}, {"horizons": (-1,)}, {"frequency_bands": ((2, "b"), (1, "a"))}],
)
def test_rules_that_cannot_work_are_refused(wrong):
    with pytest.raises(ValueError):
        Rules(**wrong)


def test_same_acquisition_reports_whatever_the_rules(ws, con):
    """Source and medium are no rule's matter."""
    assert difference(acquisition.by_source_medium(ws.acquisition()), con, STATEMENTS["sessions_by_source_medium"]) is None
