"""Stored tables and the workspace."""

from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace

import pytest
from event_rows import SF_DIR
from pyspark.errors import AnalysisException

from testbed import store
from testbed.event_log import event_log
from trailmark.sources import tables
from trailmark.sources.tables import replace_table, write_files
from trailmark.workspace import Workspace


def rows(df):
    return sorted(map(str, df.collect()))


def test_files_are_written_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert rows(write_files(spark.range(3), path)) == rows(spark.range(3).toDF("id"))
    with pytest.raises(AnalysisException):
        write_files(spark.range(5), path)
    assert spark.read.parquet(path).count() == 3


def test_table_is_created_and_replaced_by_name(spark):
    assert replace_table(spark.range(3), "some_table").count() == 3
    assert replace_table(spark.range(4).selectExpr("id", "id * 2 AS twice"), "some_table").count() == 4
    assert spark.table("some_table").columns == ["id", "twice"]
    assert replace_table(spark.table("some_table").filter("id > 0"), "some_table").count() == 3
    tables.drop_table(spark, "some_table")


def leftovers(spark, table):
    """Snapshots by entry and by folder."""
    home = Path(spark.catalog.getDatabase("default").locationUri.removeprefix("file:"))
    return tables.snapshots(spark, table), sorted(p.name for p in home.glob(f"{table}__v*"))


def test_snapshots_are_kept_and_removed(spark):
    for n in range(1, 5):
        replace_table(spark.range(n), "counted")
    names, folders = leftovers(spark, "counted")
    assert len(names) == 2 and names == folders
    assert [spark.table(t).count() for t in names] == [3, 4]
    replace_table(spark.range(9), "counted", keep=1)
    assert len(leftovers(spark, "counted")[0]) == 1
    tables.drop_table(spark, "counted")
    assert leftovers(spark, "counted") == ([], []) and not spark.catalog.tableExists("counted")


def test_failure_between_writing_and_turning_keeps_the_old_rows(spark, monkeypatch):
    replace_table(spark.range(5), "turned")
    before = leftovers(spark, "turned")
    seen = []

    def fail(spark, database, name, snapshot):
        # At this point the new rows are whole and the old ones are still read.
        seen.append((spark.table(snapshot).count(), spark.table("turned").count()))
        raise RuntimeError("stopped between the steps")

    monkeypatch.setattr(tables, "_point", fail)
    with pytest.raises(RuntimeError, match="between the steps"):
        replace_table(spark.range(7), "turned")
    assert seen == [(7, 5)]
    assert spark.table("turned").count() == 5 and leftovers(spark, "turned") == before
    monkeypatch.undo()
    assert replace_table(spark.range(7), "turned").count() == 7
    tables.drop_table(spark, "turned")


def test_reader_ends_on_the_rows_it_began_with(spark):
    replace_table(spark.range(5), "read_on")
    reader = spark.table("read_on")
    replace_table(spark.range(50), "read_on")
    assert reader.count() == 5 and spark.table("read_on").count() == 50
    tables.drop_table(spark, "read_on")


def test_first_build_that_fails_leaves_nothing(spark):
    broken = spark.range(5).selectExpr("if(id = 4, raise_error('stop'), id) AS id")
    with pytest.raises(Exception, match="stop"):
        replace_table(broken, "never_built")
    assert leftovers(spark, "never_built") == ([], []) and not spark.catalog.tableExists("never_built")


def test_leftovers_of_a_killed_job_go_with_the_next_replacement(spark):
    replace_table(spark.range(1), "killed")
    spark.range(2).write.option("path", tables._folder(spark, "default", "killed__v000002_0123abcd")).saveAsTable(
        "killed__v000002_0123abcd"
    )
    replace_table(spark.range(3), "killed", keep=1)
    names, folders = leftovers(spark, "killed")
    assert len(names) == 1 and names == folders and spark.table("killed").count() == 3
    tables.drop_table(spark, "killed")


def test_names_that_begin_alike_are_kept_apart(spark):
    replace_table(spark.range(1), "part")
    replace_table(spark.range(2), "part__v2")
    for _ in range(3):
        replace_table(spark.range(3), "part")
    assert spark.table("part__v2").count() == 2 and len(tables.snapshots(spark, "part__v2")) == 1
    for name in ("part", "part__v2"):
        tables.drop_table(spark, name)


def test_plain_table_of_the_name_is_refused(spark):
    spark.range(2).write.saveAsTable("plain")
    with pytest.raises(ValueError, match="plain is a table"):
        replace_table(spark.range(3), "plain")
    assert spark.table("plain").count() == 2 and tables.snapshots(spark, "plain") == []
    spark.sql("DROP TABLE plain")


def test_folders_and_buckets_of_a_replaced_table(spark):
    df = spark.range(100).selectExpr("id", "id % 3 AS part", "uuid() AS x")
    found = replace_table(df, "laid_out", folders=["part"])
    assert found.columns == ["id", "x", "part"]
    text = found.filter("part = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in text
    left = replace_table(df, "left_side", buckets=(4, "id"))
    right = replace_table(df.withColumnRenamed("x", "y"), "right_side", buckets=(4, "id"))
    joined = left.hint("merge").join(right, "id")
    assert joined.count() == 100
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    for name in ("laid_out", "left_side", "right_side"):
        tables.drop_table(spark, name)


def test_failed_build_leaves_the_old_table(spark):
    replace_table(spark.range(5), "kept_table")
    broken = spark.range(5).selectExpr("if(id = 4, raise_error('stop'), id) AS id")
    with pytest.raises(Exception, match="stop"):
        replace_table(broken, "kept_table")
    assert spark.table("kept_table").count() == 5
    tables.drop_table(spark, "kept_table")


def test_stored_and_computed_tables_agree(spark):
    given = spark.read.parquet(f"{SF_DIR}/events.parquet")
    computed = Workspace(lambda: event_log(given), None)
    stored = store.workspace(spark, SF_DIR)
    for table in ("acquisition", "purchasers", "weekly_retention", "channel_retention"):
        left, right = getattr(computed, table)(), getattr(stored, table)()
        assert rows(left) == rows(right)


def test_all_tables_are_written(spark, tmp_path):
    written = store.workspace(spark, SF_DIR).write_all(
        lambda df, name: write_files(df, f"{tmp_path}/{name}")
    )
    assert set(written) == {
        "session_acquisition",
        "session_ecommerce_performance",
        "session_marketing_performance",
        "session_marketing_performance_final",
        "user_purchase_frequency",
        "cohort_weekly_retention",
        "channel_retention",
    }
    for name, table in written.items():
        assert spark.read.parquet(f"{tmp_path}/{name}").count() == table.count() > 0


def test_tables_go_to_the_checkpoint_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    files = store.workspace(spark, SF_DIR).facts().inputFiles()
    assert files and all(root in file for file in files)


def test_changed_input_gets_its_own_tables(spark, tmp_path):
    given = spark.read.parquet(f"{SF_DIR}/events.parquet")
    target = str(tmp_path / "events.parquet")
    given.write.parquet(target)
    first = store.workspace(spark, str(tmp_path))
    assert first.events().count() == 1000
    assert store.workspace(spark, str(tmp_path)) is first
    given.limit(100).write.mode("overwrite").parquet(target)
    second = store.workspace(spark, str(tmp_path), version="2")
    assert second is not first
    assert second.events().count() == 100 and first.events().count() == 1000


def test_days_outside_the_period_are_left_out(spark):
    whole = store.workspace(spark, SF_DIR).events()
    days = sorted(r["event_date"] for r in whole.select("event_date").distinct().collect())
    assert len(days) > 2
    inner = store.workspace(spark, SF_DIR, start=days[1], end=days[-2]).events()
    expected = whole.filter((whole.event_date > days[0]) & (whole.event_date < days[-1])).count()
    assert 0 < inner.count() == expected < whole.count()


def test_opening_a_workspace_leaves_the_session_as_it_is(spark):
    before = spark.conf.getAll
    store.workspace(spark, SF_DIR, version="settings").facts()
    assert spark.conf.getAll == before


@pytest.mark.parametrize(
    ("setting", "set_by_call", "master", "expected"),
    [
        ("s3a://shared/c/", None, "spark://host:7077", "s3a://shared/c"),
        (None, "hdfs://n/c", "spark://host:7077", "hdfs://n/c"),
    ],
)
def test_folder_of_the_tables(setting, set_by_call, master, expected):
    context = SimpleNamespace(
        master=master, applicationId="a", getCheckpointDir=lambda: set_by_call
    )
    session = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: setting), sparkContext=context
    )
    assert store.shared_root(session) == expected


@pytest.mark.parametrize("master", ["spark://host:7077", "local-cluster[2,1,1024]", "yarn"])
def test_cluster_without_a_shared_folder_is_refused(master):
    context = SimpleNamespace(master=master, applicationId="a", getCheckpointDir=lambda: None)
    session = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context
    )
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_root(session)


def test_local_folder_where_none_is_set():
    context = SimpleNamespace(master="local[2]", applicationId="b", getCheckpointDir=lambda: None)
    session = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context
    )
    root = store.shared_root(session)
    assert root and store.shared_root(session) == root
