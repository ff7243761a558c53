"""One workspace per application and input, kept in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from testbed.event_log import event_log, write_event_log
from trailmark.sources.event_log import PERIOD_END, PERIOD_START, read_events
from trailmark.workspace import Workspace

_lock = threading.Lock()
_workspaces: dict[tuple, Workspace] = {}
_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder all executors reach: ``spark.checkpoint.dir``, which a cluster must set.

    Only a session in one process may leave it out; it then gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="trailmark-")
    return _local_roots[app]


def workspace(
    spark: SparkSession,
    sf_dir: str,
    version: str = "",
    start: str = PERIOD_START,
    end: str = PERIOD_END,
) -> Workspace:
    """Workspace on the events under ``sf_dir`` of the days ``start`` to ``end``.

    Tables are built once for a path, period and ``version``; name another version when the
    files under the path have changed. Nothing is listed to find that out.
    """
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    key = (spark.sparkContext.applicationId, path, version, start, end)
    with _lock:
        if key not in _workspaces:
            _workspaces[key] = _open(spark, path, start, end)
        return _workspaces[key]


def _open(spark: SparkSession, path: str, start: str, end: str) -> Workspace:
    root = f"{shared_root(spark)}/trailmark-{uuid.uuid4().hex}"
    log: list[DataFrame] = []
    writing = threading.Lock()

    def events() -> DataFrame:
        with writing:
            if not log:
                write_event_log(spark.read.parquet(path), f"{root}/event_log")
                log.append(read_events(spark, f"{root}/event_log", start, end))
        return log[0]

    return Workspace(events, root)
