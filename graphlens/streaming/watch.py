"""Folders that are indexed as they change: source of changes, last operations, and the graph's update by batch."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.index import index_incremental
from ..sources.folder import changes_below
from ..sources.snapshots import Store
from . import changes

_STATUS = {"created": "added", "modified": "modified", "deleted": "deleted"}


def as_statuses(events: DataFrame) -> DataFrame:
    """repo, status, old_path, new_path of the last operation of each path, for index_incremental; moves are already two events."""
    last = changes.last_operations(events)
    status = F.create_map(*(F.lit(x) for kv in _STATUS.items() for x in kv))[F.col("op")]
    return last.select("repo", status.alias("status"), F.when(F.col("op") != "created", F.col("path")).alias("old_path"), F.when(F.col("op") != "deleted", F.col("path")).alias("new_path")).where("status IS NOT NULL")


def contents(store: Store, folder: str, changed: DataFrame, limit_bytes: int) -> DataFrame:
    """repo, path, content of the changed files that are there, are UTF-8 and have at most limit_bytes; read by the tasks."""
    paths = changed.where("new_path IS NOT NULL").select("repo", F.col("new_path").alias("path"))
    root = folder.removeprefix("file://").rstrip("/")

    def read(batches):
        import os

        import pyarrow as pa

        for batch in batches:
            rows = []
            for repo, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    if os.path.getsize(f"{root}/{path}") <= limit_bytes:
                        with open(f"{root}/{path}", encoding="utf-8") as f:
                            rows.append((repo, path, f.read()))
                except (OSError, UnicodeDecodeError):  # gone meanwhile, or no text
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)] or [pa.array([], pa.string())] * 3, names=["repo", "path", "content"])

    return paths.mapInArrow(read, "repo string, path string, content string")


def watch(store: Store, folder: str, repo: str, state: str, checkpoint: str, extensions: Iterable[str], excluded: Iterable[str] = (), limit_bytes: int = 500 << 10, every: str | None = None):
    """Starts the stream that keeps store's graph like the folder; with `every`, on a schedule, else for what is there now.

    A batch that is run again after a failure gives the same graph: it replaces nodes by path. A file that changed again since
    its event is read as it is now, and its next event changes nothing. A file over the limit, or that is no UTF-8, loses its nodes.
    """
    spark = store.spark
    events = changes.relevant(changes.moves_as_two(changes_below(spark, folder, state, repo)), list(extensions), list(excluded))

    def apply(batch: DataFrame, _: int) -> None:
        statuses = as_statuses(batch).persist()
        if statuses.count():
            index_incremental(store, statuses, contents(store, folder, statuses, limit_bytes))
        statuses.unpersist()

    writer = events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
