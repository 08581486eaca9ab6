"""File-change events: last operation, sessions with a gap and a maximal length, and upserts by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import any_glob


def relevant(events: DataFrame, extensions, excluded) -> DataFrame:
    """events(repo, path, op, ts) of the extensions, none of whose path parts matches an excluded glob."""
    ext = F.lower(F.regexp_extract("path", "(\\.[^./]+)$", 1))
    return events.where(ext.isin(*extensions)).where(~F.exists(F.split("path", "/"), lambda p: any_glob(p, excluded)))


def moves_as_two(events: DataFrame) -> DataFrame:
    """events(repo, path, op, ts, event_id, dest): a move is a deletion of its path and a creation of its destination."""
    moved = F.col("op") == "moved"
    parts = F.when(moved & F.col("dest").isNotNull() & (F.col("dest") != ""), F.array(F.struct("path", F.lit("deleted").alias("op")), F.struct(F.col("dest").alias("path"), F.lit("created").alias("op"))))
    parts = parts.otherwise(F.array(F.struct("path", F.when(moved, "deleted").otherwise(F.col("op")).alias("op"))))
    return events.withColumn("_e", F.explode(parts)).withColumns({"path": F.col("_e.path"), "op": F.col("_e.op")}).drop("_e", "dest")


def live_sessions(updates: DataFrame, days: int = 7) -> DataFrame:
    """The last update of each session; on a stream, sessions that were quiet for so many days leave the state.

    updates(session_id, ts): a window of each session's updates that ends `days` after the last one, with a watermark of the
    same length on a stream. Columns: session_id, started, updated.
    """
    gap = f"{days} days"
    u = updates.withWatermark("ts", gap) if updates.isStreaming else updates
    return u.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("started"), F.max("ts").alias("updated")).select("session_id", "started", "updated")


def refresh_every(source: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str, every: str = "10 minutes"):
    """Calls refresh(batch, batch_id) on a schedule, for a catalogue that is rebuilt as a whole whenever its source has news."""
    return source.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def last_operations(events: DataFrame) -> DataFrame:
    """The last operation of each path; ties go to the greater event id."""
    return events.groupBy("repo", "path").agg(F.max_by("op", F.struct("ts", "event_id")).alias("op"), F.max("ts").alias("ts"))


def debounced(events: DataFrame, gap: str = "1 second", watermark: str | None = "10 seconds") -> DataFrame:
    """Bursts of a repository's events with no pause of `gap` inside: repo, start, end, n. Works on batches and streams.

    On a stream, events later than the watermark are dropped.
    """
    e = events.withWatermark("ts", watermark) if watermark and events.isStreaming else events
    return e.groupBy("repo", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("repo", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def marked_batches(events: DataFrame, gap_seconds: float, longest_seconds: float) -> DataFrame:
    """events with us, the number of their burst and of the part of it that they fall into."""
    by = Window.partitionBy("repo").orderBy("ts", "event_id")
    us = F.unix_micros("ts")
    new = F.coalesce((us - F.lag(us).over(by) >= int(gap_seconds * 1e6)).cast("int"), F.lit(1))
    marked = events.withColumns({"us": us, "new": new}).withColumn("burst", F.sum("new").over(by)).drop("new")
    first = F.min("us").over(Window.partitionBy("repo", "burst"))
    return marked.withColumn("cut", F.floor((F.col("us") - first) / int(longest_seconds * 1e6)))


def batches(events: DataFrame, gap_seconds: float = 1.0, longest_seconds: float = 2.0) -> DataFrame:
    """Bursts that also end `longest_seconds` after they began: repo, start, n; a burst is cut at multiples of that length.

    On tables; `stateful.flushes` gives them on a stream, with their paths.
    """
    marked = marked_batches(events.select("repo", "ts", "event_id"), gap_seconds, longest_seconds)
    return marked.groupBy("repo", "burst", "cut").agg(F.min("ts").alias("start"), F.count("*").alias("n")).select("repo", "start", "n")


def upsert_each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Starts a stream whose batches go to `apply(batch, batch_id)`; the checkpoint makes a restart go on where it ended."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
