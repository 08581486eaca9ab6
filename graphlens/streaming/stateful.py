"""Change events with state by key: batches with a pause and a longest length, and the last operation of each path.

Both run on transformWithState with event-time timers, so they need the RocksDB state store (`rocksdb`). Events at or before
the watermark are late and are dropped by Spark; all others are taken in the order of their time, whatever order they come in.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

FLUSH = "repo string, start timestamp, end timestamp, n long, changed array<string>, deleted array<string>"
_EVENT = "us long, event_id long, path string, op string"
LAST = "repo string, path string, op string, ts timestamp, event_id long"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _ms(us: int) -> int:
    """The first millisecond at or after us."""
    return -(-us // 1000)


class Flushes(StatefulProcessor):
    """State of a repository: events that later ones may still precede, and the open batch.

    The open batch: begin of its burst, number of its cut, first and last event, count; its paths with their last operation
    are a map of their own. Timers: the first waiting event, the end of the pause and the end of the longest length.
    """

    def __init__(self, gap_us: int, longest_us: int):
        self.gap, self.longest = gap_us, longest_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _EVENT)
        self.open = handle.getValueState("open", "burst long, cut long, first long, last long, n long")
        self.paths = handle.getMapState("paths", "path string", "op string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        self.waiting.appendList([(r.us, r.event_id, r.path, r.op) for r in rows])
        yield from self._advance(key, timerValues)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key, timerValues)

    def _flush(self, key, batch, paths: dict[str, str]) -> Row:
        changed, deleted = [], []
        for path, op in paths.items():
            (deleted if op == "deleted" else changed).append(path)
        paths.clear()
        return Row(repo=key[0], start=batch[2], end=batch[3], n=batch[4], changed=sorted(changed), deleted=sorted(deleted))

    def _advance(self, key, timerValues: TimerValues) -> Iterator[Row]:
        """Takes all events up to the watermark, then sets the timers that changed. Each call of the state crosses to the JVM, so the
        paths are read and written once, not at each event."""
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready = [e for e in waiting if e[0] <= mark]
        before = batch = tuple(self.open.get()) if self.open.exists() else None
        stored = {path: op for (path,), (op,) in self.paths.iterator()} if batch is not None and batch[4] else {}
        paths = dict(stored)
        for us, _, path, op in ready:
            fresh = batch is None or us - batch[3] >= self.gap
            if batch is not None and (fresh or (us - batch[0]) // self.longest != batch[1]):
                if batch[4]:
                    yield self._flush(key, batch, paths)
                batch = None if fresh else (batch[0], (us - batch[0]) // self.longest, us, us, 0)
            if batch is None:
                batch = (us, 0, us, us, 0)
            batch = (*batch[:3], us, batch[4] + 1)
            paths[path] = op
        # the burst's begin and last event stay known while an event after the longest length may still go on with it
        if batch is not None and batch[4] and (batch[3] + self.gap <= mark + 1 or (mark + 1 - batch[0]) // self.longest != batch[1]):
            yield self._flush(key, batch, paths)
            batch = (*batch[:4], 0)
        if batch is not None and batch[3] + self.gap <= mark + 1:
            batch = None
        if ready:
            rest = waiting[len(ready) :]
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        else:
            rest = waiting
        if any(path not in paths for path in stored):
            self.paths.clear()
            stored = {}
        for path, op in paths.items():
            if stored.get(path) != op:
                self.paths.updateValue((path,), (op,))
        if batch is None and before is not None:
            self.open.clear()
        elif batch != before:
            self.open.update(batch)
        times = {_ms(rest[0][0])} if rest else set()
        if batch is not None:
            times.add(_ms(batch[3] + self.gap - 1))
            if batch[4]:
                times.add(_ms(batch[0] + (batch[1] + 1) * self.longest - 1))
        there = set(self.handle.listTimers())
        for t in there - times:
            self.handle.deleteTimer(t)
        for t in times - there:
            self.handle.registerTimer(t)


def flushes(events: DataFrame, gap_seconds: float = 1.0, longest_seconds: float = 2.0, watermark: str = "10 seconds") -> DataFrame:
    """Batches of a repository's events(repo, path, op, ts, event_id): repo, start, end, n, changed, deleted.

    A batch ends at a pause of gap_seconds, and at multiples of longest_seconds after its burst began. Of a path's operations
    the last one in the batch decides the list that it is in. On a stream a batch comes out once the watermark has passed
    its end, in append mode; on a table the same batches come from windows. A repository's batch is one row, so its paths have
    to fit one: longest_seconds bounds them.
    """
    e = events.select(F.col("repo").cast("string").alias("repo"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("op", F.lit("")).alias("op"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"))
    gap, longest = int(gap_seconds * 1e6), int(longest_seconds * 1e6)
    if events.isStreaming:
        e = e.withWatermark("ts", watermark).withColumn("us", F.unix_micros("ts"))
        raw = FLUSH.replace("timestamp", "long")
        out = e.groupBy("repo").transformWithState(Flushes(gap, longest), raw, "append", "eventTime")
        return out.withColumns({"start": F.timestamp_micros("start"), "end": F.timestamp_micros("end")})
    from .changes import marked_batches

    last = marked_batches(e, gap_seconds, longest_seconds).groupBy("repo", "burst", "cut", "path").agg(F.max_by("op", F.struct("us", "event_id")).alias("op"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))
    lists = [F.sort_array(F.collect_list(F.when(c, F.col("path")))).alias(name) for name, c in (("changed", F.col("op") != "deleted"), ("deleted", F.col("op") == "deleted"))]
    return last.groupBy("repo", "burst", "cut").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), *lists).drop("burst", "cut")


def flushed(spark: SparkSession, events: str, schema: str, to_events, gap_seconds: float, longest_seconds: float, root: str, watermark: str = "10 seconds") -> DataFrame:
    """The batches of a folder of event files that is complete, from a stream with its checkpoint below root.

    to_events turns rows of the files into events(repo, path, op, ts, event_id). A first run takes all files. Batches that are
    open then come out in a second one, which goes on from the checkpoint with one event, of no repository, that moves the
    watermark past all others.
    """
    end = f"{root}/end"
    spark.createDataFrame([], "ts timestamp").write.parquet(end)

    def run() -> None:
        own = to_events(spark.readStream.schema(schema).parquet(events))
        last = spark.readStream.schema("ts timestamp").parquet(end).selectExpr("cast(null as string) repo", "cast(null as string) path", "cast(null as string) op", "ts", "-1L event_id")
        stream = flushes(own.selectExpr("cast(repo as string) repo", "path", "op", "cast(ts as timestamp) ts", "event_id").unionByName(last), gap_seconds, longest_seconds, watermark)
        writer = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()

    with rocksdb(spark):
        run()
        latest = to_events(spark.read.schema(schema).parquet(events)).agg(F.max(F.col("ts").cast("timestamp")).alias("ts"))
        far = F.make_interval(days=F.lit(1), secs=F.lit(2 * (gap_seconds + longest_seconds)))
        latest.select((F.coalesce("ts", F.timestamp_micros(F.lit(0))) + far).alias("ts")).coalesce(1).write.mode("append").parquet(end)
        run()
    return spark.read.schema(FLUSH).parquet(f"{root}/out").where("repo IS NOT NULL")


class LastOperation(StatefulProcessor):
    """The last operation of a path, with a timer that ends it."""

    def __init__(self, keep_us: int):
        self.keep = keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long, event_id long, op string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        before = tuple(self.last.get()) if self.last.exists() else None
        now = before
        for r in rows:
            new = (r.us, r.event_id, r.op)
            if now is None or new[:2] > now[:2]:
                now = new
        if now == before:
            return
        self.last.update(now)
        if before is not None:
            self.handle.deleteTimer(_ms(before[0] + self.keep))
        self.handle.registerTimer(_ms(now[0] + self.keep))
        yield Row(repo=key[0], path=key[1], op=now[2], ts=now[0], event_id=now[1])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter(())


def last_operations_stream(events: DataFrame, keep: str = "1 hour", keep_seconds: float = 3600.0, watermark: str | None = None) -> DataFrame:
    """repo, path, op, ts, event_id of each path whose last operation changed, in update mode.

    An event that is older than its path's last one changes nothing; ties in time go to the greater event id. A path's state
    ends keep_seconds after its last event, by the watermark. The watermark is `keep` behind unless given: then an event that
    meets no state is never older than one that state was dropped for.
    """
    e = events.select(F.col("repo").cast("string").alias("repo"), "path", "op", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"))
    e = e.withWatermark("ts", watermark or keep).withColumn("us", F.unix_micros("ts"))
    out = e.groupBy("repo", "path").transformWithState(LastOperation(int(keep_seconds * 1e6)), LAST.replace("timestamp", "long"), "update", "eventTime")
    return out.withColumn("ts", F.timestamp_micros("ts"))
