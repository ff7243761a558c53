"""Shape of the physical plans: what is read, what is shuffled, what is avoided."""

from __future__ import annotations

import re

import pytest
from event_rows import SF_DIR, event

import __spark_entry__ as registry
from oracle.statements import all_statements
from testbed.store import workspace
from trailmark.functions.calendar import utc_date, within_utc_days
from trailmark.operators.cohorts import exact_day_retention
from trailmark.operators.sessions import session_facts
from trailmark.plans import acquisition, behaviour, dashboards, models, performance, profiling, traffic
from trailmark.sources.event_log import read_events


def plan(df) -> str:
    """Physical plan before adaptive execution."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[-1]


def shuffles(df) -> list[str]:
    """Keys of the hash shuffles, subqueries included."""
    return re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan(df))


@pytest.fixture(scope="module")
def ws(spark):
    return workspace(spark, SF_DIR)


@pytest.fixture(scope="module")
def stored_log(spark, ws):
    """Path of the stored event log."""
    return ws.events().inputFiles()[0].split("/event_date=")[0]


def test_days_prune_partitions(spark, stored_log):
    text = plan(read_events(spark, stored_log, "20201201", "20201207"))
    assert re.search(r"PartitionFilters: \[.*event_date.*20201201.*20201207", text)
    files = read_events(spark, stored_log, "20201201", "20201207")
    assert 0 < files.select("event_date").distinct().count() <= 7


def test_lookups_read_keys_and_one_slot(ws):
    text = plan(profiling.session_id_completeness(ws.events()))
    schema = re.search(r"ReadSchema: (\S+)", text).group(1)
    assert "int_value" in schema and "string_value" not in schema
    assert "user_pseudo_id" not in schema and "traffic_source" not in schema
    text = plan(traffic.event_sources(ws.events()))
    assert "int_value" not in re.search(r"ReadSchema: (\S+)", text).group(1)


def test_struct_fields_are_pruned(ws):
    text = plan(traffic.user_mediums(ws.events()))
    assert "ReadSchema: struct<traffic_source:struct<medium:string>>" in text


def test_reports_read_few_columns(ws):
    text = plan(performance.campaign_distribution(ws.marketing()))
    assert set(re.findall(r"ReadSchema: (\S+)", text)) == {"struct<session_campaign:string>"}


def test_session_filters_reach_the_scan(ws):
    text = plan(ws.sessions())
    assert "GreaterThanOrEqual(ga_session_number,1)" in text


def test_session_facts_scan_once_and_shuffle_combined_rows(ws):
    df = session_facts(ws.events())
    text = plan(df)
    assert text.count("FileScan") == 1 and "Join" not in text
    assert len(shuffles(df)) == 2
    # Below the first shuffle there is a partial aggregate.
    below = text.split("Exchange hashpartitioning")[-1]
    assert "partial_min" in below.split("\n")[1]


def test_acquisition_drops_unused_measures(ws):
    text = plan(models.session_acquisition(ws.events()))
    assert "event_name" not in text and "ecommerce" not in text


def test_retention_has_one_shuffle_and_no_join(ws):
    df = exact_day_retention(ws.sessions())
    assert len(shuffles(df)) == 1
    assert "Join" not in plan(df)
    # Days are bits of numbers, not a set that grows.
    assert "ObjectHashAggregate" not in plan(df) and "collect_set" not in plan(df)
    assert "bit_or" in plan(df)


def aggregates(text: str) -> list[str]:
    """Names of the aggregates, the one nearest to the scan last."""
    return re.findall(r"(\w*Aggregate)\(", text)


def test_raw_events_are_hashed_never_sorted(ws):
    for df in (session_facts(ws.events()), traffic.session_first_traffic(ws.events())):
        text = plan(df)
        # What lies between the scan and the first shuffle, which works on raw events.
        below = text.split("Exchange hashpartitioning")[-1]
        assert aggregates(below)[0] == "HashAggregate" and "Sort" not in below
    assert "SortAggregate" not in plan(session_facts(ws.events()))


def test_sessions_are_grouped_by_numbers_before_they_are_named(ws):
    reports = (
        models.session_ecommerce_performance(ws.events()),
        behaviour.new_vs_returning_funnel(ws.events()),
        traffic.attribution_coverage(ws.events()),
    )
    for df in reports:
        below = plan(df).split("Exchange hashpartitioning")[-1]
        assert "concat" not in below
        assert any(keys.startswith("ga_session_id") for keys in shuffles(df))


def test_days_and_channels_reach_the_scan(ws):
    df = dashboards.kpi_summary(ws.sessions(), "2020-12-05", "2020-12-20", ("Direct", "Email"))
    text = plan(df)
    folders = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", text).group(1)
    assert "session_month" in folders and "2020-12-01" in folders
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    assert "GreaterThanOrEqual(session_date,2020-12-05)" in pushed
    assert "LessThanOrEqual(session_date,2020-12-20)" in pushed
    assert "In(channel_group, [Direct,Email])" in pushed


def test_files_of_sessions_are_in_order_of_days(ws):
    files = ws.facts().inputFiles()
    assert all("session_month=" in f for f in files)
    for file in files:
        days = [r[0] for r in ws.facts().sparkSession.read.parquet(file).select("session_date").collect()]
        assert days == sorted(days)


def test_bounds_on_days_become_bounds_on_micros(ws):
    bounds = within_utc_days("earliest_event_timestamp", "2020-12-05", "2020-12-20")
    text = plan(ws.acquisition().filter(bounds))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    assert "GreaterThanOrEqual(earliest_event_timestamp,1607126400000000)" in pushed
    assert "LessThan(earliest_event_timestamp,1608508800000000)" in pushed
    on_days = ws.facts().filter("session_date BETWEEN '2020-12-05' AND '2020-12-20'").count()
    assert 0 < ws.acquisition().filter(bounds).count() == on_days


def test_calendar_days_are_integers_only(ws):
    text = plan(ws.acquisition().select(utc_date("earliest_event_timestamp")))
    assert "double" not in text and " div " in text


def test_bucketed_tables_join_without_a_shuffle(spark, ws):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = ws.joined_marketing()
        assert "SortMergeJoin" in plan(df) and "Exchange" not in plan(df)
        assert df.count() == ws.marketing().count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_totals_of_value_groups_use_no_unpartitioned_window(ws):
    for df in (
        acquisition.by_source_medium(ws.acquisition()),
        performance.campaign_distribution(ws.marketing()),
        profiling.session_frequency(ws.events()),
    ):
        assert "Window" not in plan(df)


def test_top_sessions_never_sort_globally(ws):
    assert "TakeOrderedAndProject" in plan(profiling.top_sessions(ws.events()))


@pytest.mark.parametrize("name", all_statements())
def test_no_python_rows_and_no_cross_join(spark, name):
    text = plan(registry.queries()[name](spark, SF_DIR))
    for node in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "Pandas"):
        assert node not in text


def test_hot_session_reaches_the_shuffle_as_one_row_per_task(spark, log, tmp_path):
    """A session with nearly all events leaves the map side combined."""
    rows = [event("2020-11-02 10:00:00", user="hot", session=1) for _ in range(400)]
    rows += [event("2020-11-02 10:00:00", user=f"u{i}", session=1) for i in range(20)]
    path = str(tmp_path / "log")
    log(*rows).coalesce(1).write.partitionBy("event_date").parquet(path)
    df = session_facts(read_events(spark, path, "20201101", "20201130"))
    assert df.count() == 21
    df.collect()
    written = _shuffle_records(df)
    assert max(written) <= 21


def _shuffle_records(df) -> list[int]:
    """Records written by each shuffle of an executed frame."""
    found = []

    def visit(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            visit(node.executedPlan())
            return
        if name in ("ShuffleQueryStage", "ResultQueryStage"):
            visit(node.plan())
            return
        if name == "Exchange":
            metric = node.metrics().get("shuffleRecordsWritten")
            if metric.isDefined():
                found.append(metric.get().value())
        children = node.children()
        for i in range(children.size()):
            visit(children.apply(i))

    visit(df._jdf.queryExecution().executedPlan())
    return found


def test_dataset_profile_hashes_events(ws):
    text = plan(profiling.dataset_profile(ws.events()))
    assert "HashAggregate" in text and "SortAggregate" not in text
