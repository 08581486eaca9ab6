"""Streams with state, the folder source and the watcher, each over restarts, against tables."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from graphlens.plans import index
from graphlens.sources import folder
from graphlens.sources.shared import shared_dir
from graphlens.sources.snapshots import Store
from graphlens.streaming import changes, stateful, watch

EVENT = "repo string, path string, op string, ts timestamp, event_id long"
T0 = datetime.datetime(2024, 1, 1)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def bursts(seed, n=400):
    rnd, t, rows = random.Random(seed), 0.0, []
    for k in range(n):
        t += rnd.choice((0, 0.1, 0.3, 0.5, 0.9, 1.0, 1.1, 5))
        rows.append((f"r{rnd.randrange(3)}", f"p{rnd.randrange(5)}", rnd.choice(("created", "modified", "deleted")), at(t), k))
    return rows


def flushed_by_hand(rows, gap=1.0, longest=2.0):
    out, by = [], {}
    for r in sorted(rows, key=lambda r: (r[0], r[3], r[4])):
        by.setdefault(r[0], []).append(r)
    for repo, events in by.items():
        burst, last, cut = None, None, None
        for _, path, op, ts, _ in events:
            if last is None or (ts - last).total_seconds() >= gap:
                burst, cut = ts, None
            c = int((ts - burst).total_seconds() * 1000) // int(longest * 1000)
            if c != cut:
                cut = c
                out.append([repo, ts, ts, 0, {}])
            out[-1][2], out[-1][3], last = ts, out[-1][3] + 1, ts
            out[-1][4][path] = op
    return sorted((repo, a, b, n, sorted(p for p, op in ops.items() if op != "deleted"), sorted(p for p, op in ops.items() if op == "deleted")) for repo, a, b, n, ops in out)


def test_flushes_of_a_table(spark):
    rows = bursts(3)
    got = stateful.flushes(spark.createDataFrame(rows, EVENT).repartition(4)).select("repo", "start", "end", "n", "changed", "deleted")
    assert sorted(map(tuple, got.collect())) == flushed_by_hand(rows)
    assert stateful.flushes(spark.createDataFrame([], EVENT)).count() == 0


def test_flushes_of_a_stream_over_restarts(spark, tmp_path):
    rows, rnd = bursts(1), random.Random(2)
    late = sorted(rows, key=lambda r: r[3] + datetime.timedelta(seconds=rnd.random() * 6))  # out of order within the watermark
    source = f"file://{tmp_path}/events"

    def run():
        s = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", "1").parquet(source)
        with stateful.rocksdb(spark):
            q = stateful.flushes(s).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
        return q

    for k in range(0, len(late), 100):
        spark.createDataFrame(late[k : k + 100], EVENT).coalesce(1).write.mode("append").parquet(source)
        if k in (100, 300):
            run()  # each run goes on from the checkpoint
    assert 0 < spark.read.parquet(f"{tmp_path}/out").count() < len(flushed_by_hand(rows))  # the last ones are open
    spark.createDataFrame([("end", "p", "created", at(86400), 999)], EVENT).coalesce(1).write.mode("append").parquet(source)
    q = run()
    got = spark.read.parquet(f"{tmp_path}/out").select("repo", "start", "end", "n", "changed", "deleted")
    assert sorted(map(tuple, got.collect())) == flushed_by_hand(rows)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3  # the event of the end waits alone


def test_flushes_of_a_whole_folder(spark):
    rows = bursts(5, 150)
    source = shared_dir(spark)
    spark.createDataFrame(rows, EVENT).repartition(3).write.parquet(source)
    got = stateful.flushed(spark, source, EVENT, lambda df: df, 1.0, 2.0, shared_dir(spark))
    assert sorted(map(tuple, got.select("repo", "start", "end", "n", "changed", "deleted").collect())) == flushed_by_hand(rows)


def test_last_operations_expire(spark, tmp_path):
    seen = {}
    source = f"file://{tmp_path}/events"

    def keep(batch, _):
        for r in batch.collect():
            seen[r.repo, r.path] = (r.op, r.event_id)

    def run(*rows):
        spark.createDataFrame(list(rows), EVENT).coalesce(1).write.mode("append").parquet(source)
        s = spark.readStream.schema(EVENT).parquet(source)
        with stateful.rocksdb(spark):
            q = stateful.last_operations_stream(s, "60 seconds", 60.0).writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/cp").outputMode("update").trigger(availableNow=True).start()
            q.awaitTermination()
        return q.lastProgress["stateOperators"][0]["numRowsTotal"]

    run(("r", "a", "modified", at(50), 5), ("r", "b", "created", at(10), 1), ("r", "c", "created", at(10), 2), ("r", "c", "deleted", at(10), 3))
    assert seen == {("r", "a"): ("modified", 5), ("r", "b"): ("created", 1), ("r", "c"): ("deleted", 3)}
    run(("r", "a", "created", at(20), 4), ("r", "b", "deleted", at(40), 6), ("r", "c", "created", at(10), 2))  # older than what is known, newer, repeated
    assert seen == {("r", "a"): ("modified", 5), ("r", "b"): ("deleted", 6), ("r", "c"): ("deleted", 3)}
    full = run(("r", "d", "created", at(60), 7))
    assert full >= 4
    left = run(("r", "e", "created", at(500), 8))
    assert left < full  # a to d ended with the watermark
    run(("r", "a", "created", at(30), 9))  # late: the state is gone, the event too
    assert seen["r", "a"] == ("modified", 5) and seen["r", "e"] == ("created", 8)


def put(root, path, text, when):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(text)
    os.utime(full, (when, when))


def test_changes_below_a_folder(spark, tmp_path):
    root, state = f"{tmp_path}/work", f"{tmp_path}/state"
    for path, text in {"a.py": "a", "b/c.py": "c", "b/d.py": "d", "b.py": "x", "gone.py": "g", "empty": ""}.items():
        put(root, path, text, 1000)

    def run():
        out = folder.changes_below(spark, root, state, "r")
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.parquet(f"{tmp_path}/out").orderBy("event_id").collect()
        assert len({r.event_id for r in rows}) == len(rows)
        fresh = [(r.repo, r.path, r.op, r.dest) for r in rows[len(seen) :]]
        seen.extend(fresh)
        return sorted(fresh, key=str)

    seen = []
    assert run() == sorted([("r", p, "created", None) for p in ("a.py", "b/c.py", "b/d.py", "b.py", "gone.py", "empty")], key=str)
    assert run() == []  # a restart gives nothing again
    put(root, "a.py", "changed", 2000)
    put(root, "b/d.py", "d", 2000)  # a new time only
    os.rename(f"{root}/b/c.py", f"{root}/moved.py")
    os.remove(f"{root}/gone.py")
    os.remove(f"{root}/empty")
    put(root, "also_empty", "", 2000)
    put(root, "b.py", "y", 1000)  # as long and as old as before: not seen, as documented for lengths and times
    assert run() == sorted([("r", "a.py", "modified", None), ("r", "b/c.py", "moved", "moved.py"), ("r", "gone.py", "deleted", None), ("r", "empty", "deleted", None), ("r", "also_empty", "created", None)], key=str)
    # a listing whose batch never ended is read again, not made again
    put(root, "new.py", "n", 3000)
    n = folder.State(state).advance(root)
    assert folder.State(state).advance(root) == n
    assert run() == [("r", "new.py", "created", None)]
    assert not [f for f in os.listdir(state) if f.endswith(".part")]


def test_listings_merge_in_order_of_path_parts():
    old = [("a", 1, 1, "h1"), ("a/b", 1, 1, "h2"), ("a.py", 2, 2, "h3")]
    got = {p: (a is not None, b is not None) for p, a, b in folder.merged(iter(old), iter([("a/b", 1, 1), ("a/c", 1, 1), ("a.py", 2, 3)]), lambda p: "new")}
    assert got == {"a": (True, False), "a/b": (True, True), "a/c": (False, True), "a.py": (True, True)}


def test_a_folder_is_indexed_as_it_changes(spark, tmp_path):
    root = f"{tmp_path}/work"
    store = Store(spark, f"file://{tmp_path}/store")
    put(root, "src/one.py", "class Base:\n    def run(self):\n        return 1\n", 1000)
    put(root, "two.py", "from src.one import Base\n\ndef go():\n    return Base()\n", 1000)
    put(root, "node_modules/x.py", "def skipped():\n    pass\n", 1000)
    put(root, "notes.txt", "class NoCode: pass", 1000)

    def run():
        watch.watch(store, root, "r", f"{tmp_path}/state", f"{tmp_path}/cp", [".py"], ["node_modules"]).awaitTermination()

    def fresh():
        files = spark.createDataFrame([("r", os.path.relpath(os.path.join(d, f), root), open(os.path.join(d, f)).read()) for d, _, fs in os.walk(root) for f in fs if f.endswith(".py") and "node_modules" not in d], "repo string, path string, content string")
        other = Store(spark, f"file://{shared_dir(spark).removeprefix('file://')}")
        index.index_all(other, files)
        return other

    def same(a, b):
        symbols = lambda s: {(r.id, r.kind, r.start_line) for r in s.load("nodes").where("kind NOT IN ('module', 'repository')").collect()}
        links = lambda s: {(r.source, r.target, r.kind) for r in s.load("edges").where("kind != 'contains'").collect()}
        assert symbols(a) == symbols(b) and links(a) == links(b)

    run()
    same(store, fresh())
    put(root, "two.py", "def go():\n    return third()\n", 2000)
    put(root, "three.py", "def third():\n    return Base()\n", 2000)
    os.rename(f"{root}/src/one.py", f"{root}/src/renamed.py")
    run()
    same(store, fresh())
    os.remove(f"{root}/three.py")
    run()
    same(store, fresh())
    assert {r.id for r in store.load("nodes").where("kind = 'function'").collect()} == {"r:two.py::go"}


@pytest.mark.parametrize("op", ["created", "modified", "deleted"])
def test_statuses(spark, op):
    events = spark.createDataFrame([("r", "a", op, at(1), 1), ("r", "a", "deleted" if op != "deleted" else "created", at(0), 0)], EVENT)
    r = watch.as_statuses(events).first()
    assert (r.status, r.old_path, r.new_path) == {"created": ("added", None, "a"), "modified": ("modified", "a", "a"), "deleted": ("deleted", "a", None)}[op]
    assert changes.last_operations(events).count() == 1
    assert watch.as_statuses(events.where(F.lit(False))).count() == 0


def test_flushes_write_a_batch_of_paths_once():
    from types import SimpleNamespace as Row

    from graphlens.streaming.stateful import Flushes

    class State:
        def __init__(self):
            self.held, self.writes, self.times = {}, 0, set()

        exists = lambda self: "v" in self.held
        get = lambda self: self.held["v"]
        clear = lambda self: self.held.clear()
        update = put = lambda self, v: self.held.update(v=v)
        appendList = lambda self, rows: self.held.update(v=[*self.held.get("v", []), *rows])  # noqa: E731, N815
        iterator = lambda self: iter(list(self.held.items()))

        def updateValue(self, k, v):  # noqa: N802
            self.writes += 1
            self.held[k] = v

    timers = set()
    states = {n: State() for n in ("waiting", "open", "paths")}
    handle = Row(listTimers=lambda: iter(timers), registerTimer=timers.add, deleteTimer=timers.discard, getListState=lambda n, _: states[n], getValueState=lambda n, _: states[n], getMapState=lambda n, *_: states[n])
    second = 1_000_000
    flushes = Flushes(10 * second, 100 * second)
    flushes.init(handle)
    at = lambda s: Row(getCurrentWatermarkInMs=lambda: s * 1000)
    rows = [Row(us=k * second, event_id=k, path=f"p{k % 3}", op="deleted" if k % 3 == 2 else "modified") for k in range(1, 41)]
    assert not list(flushes.handleInputRows(("r",), iter(rows), at(20))) and states["paths"].writes == 3
    assert not list(flushes.handleExpiredTimer(("r",), at(30), None)) and states["paths"].writes == 3
    out = list(flushes.handleExpiredTimer(("r",), at(60), None))
    assert [(r.start, r.end, r.n, r.changed, r.deleted) for r in out] == [(second, 40 * second, 40, ["p0", "p1"], ["p2"])]
    assert states["paths"].writes == 3 and not states["paths"].held and not states["open"].held and not timers
