"""Derived tables: write, lay out, create or replace, and read back."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def write_files(df: DataFrame, path: str, folders: Sequence[str] = ()) -> DataFrame:
    """Write the rows of ``df`` to the new folder ``path`` and return a reader on it.

    Values of the columns ``folders`` become folder names, which filters prune. Fails if
    the folder exists, so a build that fails later never costs older rows.
    """
    df.write.partitionBy(*folders).parquet(path)
    # The schema is known, so reading back needs no inference job.
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)


def by_month_and_day(sessions: DataFrame, month: str, day: str, *then: str) -> DataFrame:
    """Rows of a day brought together, tasks of like size, each sorted by month, day and the columns ``then``.

    Written with ``month`` as folder, each file holds few days in order, so a filter on days skips files
    and row groups. A heavy day is split over several tasks, light ones share one.
    """
    return sessions.hint("rebalance", day).sortWithinPartitions(month, day, *then)


def write_bucketed(df: DataFrame, path: str, table: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` as the new catalog table ``table``, dealt into ``buckets`` files by ``key`` and sorted by it.

    Two tables with the same number of buckets join on their keys without a shuffle.
    """
    dealt = df.repartition(buckets, key)
    dealt.write.format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return df.sparkSession.table(table)


# Tables that are replaced under a name: snapshots, and a view on the newest one.

_SNAPSHOT = re.compile(r"__v(\d{6,})_[0-9a-f]{8}$")


def _names(spark: SparkSession, table: str) -> tuple[str, str]:
    database, _, name = table.rpartition(".")
    return database or spark.catalog.currentDatabase(), name


def _quoted(*parts: str) -> str:
    return ".".join(f"`{p}`" for p in parts)


def snapshots(spark: SparkSession, table: str) -> list[str]:
    """Names of the stored snapshots of ``table``, oldest first."""
    database, name = _names(spark, table)
    found = [t.name for t in spark.catalog.listTables(database) if t.name.startswith(f"{name.lower()}__v")]
    own = [t for t in found if _SNAPSHOT.search(t) and t[: _SNAPSHOT.search(t).start()] == name.lower()]
    return sorted(own, key=lambda t: int(_SNAPSHOT.search(t).group(1)))


def _folder(spark: SparkSession, database: str, snapshot: str) -> str:
    return f"{spark.catalog.getDatabase(database).locationUri.rstrip('/')}/{snapshot}"


def _discard(spark: SparkSession, database: str, snapshot: str) -> None:
    """Remove a snapshot's entry, if there is one, and its files."""
    spark.sql(f"DROP TABLE IF EXISTS {_quoted(database, snapshot)}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark, database, snapshot))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _point(spark: SparkSession, database: str, name: str, snapshot: str) -> None:
    """Let the view ``name`` show the rows of ``snapshot``: one change of one catalog entry."""
    exists = spark.catalog.tableExists(_quoted(database, name))
    action = "ALTER VIEW" if exists else "CREATE VIEW"
    spark.sql(f"{action} {_quoted(database, name)} AS SELECT * FROM {_quoted(database, snapshot)}")


def replace_table(
    df: DataFrame,
    table: str,
    keep: int = 2,
    folders: Sequence[str] = (),
    buckets: tuple[int, str] | None = None,
) -> DataFrame:
    """Create or replace ``table`` with the rows of ``df``, without a moment at which there is none.

    The rows are written whole as a snapshot of their own; then the view ``table`` is turned to it in one step. A build
    that fails, or a turn that does, removes its snapshot and leaves the view on the old rows, and ``df`` may read them.
    The newest ``keep`` snapshots stay, so a reader that began before a replacement ends on the rows it began with. What
    a killed job left behind goes with the next replacement; a table has one writer at a time.

    ``folders``: columns whose values become folders. ``buckets``: a number and a key, as in :func:`write_bucketed`;
    the view keeps both properties. A table of that name which is no view is refused.
    """
    spark = df.sparkSession
    database, name = _names(spark, table)
    if spark.catalog.tableExists(_quoted(database, name)):
        if spark.catalog.getTable(_quoted(database, name)).tableType != "VIEW":
            raise ValueError(f"{table} is a table, not a view on snapshots: drop or rename it first")
    older = snapshots(spark, table)
    number = 1 + max((int(_SNAPSHOT.search(t).group(1)) for t in older), default=0)
    snapshot = f"{name.lower()}__v{number:06d}_{uuid.uuid4().hex[:8]}"
    try:
        if buckets:
            df = df.repartition(*buckets)
        writer = df.write.format("parquet").option("path", _folder(spark, database, snapshot)).partitionBy(*folders)
        if buckets:
            writer = writer.bucketBy(*buckets).sortBy(buckets[1])
        writer.saveAsTable(_quoted(database, snapshot))
        _point(spark, database, name, snapshot)
    except BaseException:
        _discard(spark, database, snapshot)
        raise
    for old in [*older, snapshot][: -max(keep, 1)]:
        _discard(spark, database, old)
    return spark.table(_quoted(database, name))


def drop_table(spark: SparkSession, table: str) -> None:
    """Remove the view ``table`` and all its snapshots."""
    database, name = _names(spark, table)
    spark.sql(f"DROP VIEW IF EXISTS {_quoted(database, name)}")
    for snapshot in snapshots(spark, table):
        _discard(spark, database, snapshot)
