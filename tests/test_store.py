"""The log of commits, tables kept by deltas, the kept BM25 index and incremental links, against whole rebuilds."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from graphlens.operators import link, summaries, text, text_index
from graphlens.plans import index
from graphlens.sources import snapshots
from graphlens.sources.kept import Kept
from graphlens.sources.shared import shared_dir
from graphlens.sources.snapshots import Append, Conflict, Store

ITEM = "id string, x int"


def items(spark, *rows):
    return spark.createDataFrame(list(rows), ITEM)


@pytest.fixture
def store(spark):
    return Store(spark, shared_dir(spark))


def pairs(df):
    return sorted((r[0], r[1]) for r in df.collect())


def test_a_commit_is_seen_whole(spark, store, monkeypatch):
    store.commit(lambda _: {"a": items(spark, ("1", 1)), "b": items(spark, ("1", 1))})
    before = store.view()
    # between the tables
    broken = spark.range(2).select(F.raise_error(F.lit("broken")).cast("string").alias("id"), F.lit(1).alias("x"))
    with pytest.raises(Exception, match="broken"):
        store.commit(lambda _: {"a": items(spark, ("2", 2)), "b": broken})
    # between the data and the entry
    put = Store._put
    monkeypatch.setattr(Store, "_put", lambda *a: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError, match="crash"):
        store.commit(lambda _: {"a": items(spark, ("3", 3)), "b": items(spark, ("3", 3))})
    monkeypatch.setattr(Store, "_put", put)
    assert store.view().number == before.number and pairs(store.load("a")) == pairs(store.load("b")) == [("1", 1)]
    store.commit(lambda view: {"a": view.load("a").unionByName(items(spark, ("4", 4)))})
    assert pairs(store.load("a")) == [("1", 1), ("4", 4)] and pairs(store.load("b")) == [("1", 1)]
    assert pairs(before.load("a")) == [("1", 1)]  # an open view stays
    assert store.commit(lambda _: {}).number == before.number + 1


def test_racing_writers_lose_nothing(spark, store):
    store.save("a", items(spark))
    barrier, tried, failed = threading.Barrier(3), [], []

    def writer(k):
        first = [True]

        def change(view):
            tried.append(k)
            if first[0]:
                first[0] = False
                barrier.wait(60)  # all three read the same commit
            return {"a": view.load("a").unionByName(items(spark, (str(k), k)))}

        try:
            store.commit(change)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=writer, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and pairs(store.load("a")) == [("0", 0), ("1", 1), ("2", 2)]
    assert len(tried) > 3 and store._numbers() == [0, 1, 2, 3]


def test_writers_of_other_tables_are_moved_behind(spark, store):
    store.save("a", items(spark, ("1", 1)))
    calls = []

    def change(view):
        calls.append(view.number)
        if len(calls) == 1:
            store.save("b", items(spark, ("2", 2)))  # another writer, another table
        return {"a": Append(items(spark, ("3", 3)))}

    assert store.commit(change).number == 2
    assert calls == [0] and pairs(store.load("a")) == [("1", 1), ("3", 3)] and pairs(store.load("b")) == [("2", 2)]

    def always_late(view):
        store.save("a", view.load("a"))
        return {"a": items(spark, ("9", 9))}

    with pytest.raises(Conflict):
        store.commit(always_late, tries=2)
    assert pairs(store.load("a")) == [("1", 1), ("3", 3)]


def test_an_entry_never_replaces_another(store):
    assert store._put(0, {"a": ["x"]}) and not store._put(0, {"a": ["y"]})
    assert store._entry(0) == {"a": ["x"]} and store._numbers() == [0]


def test_old_states_go(spark, store):
    for k in range(4):
        store.commit(lambda _, k=k: {"a": items(spark, ("a", k)), **({"b": items(spark, ("b", k))} if k == 0 else {})})
    store.vacuum("a", 2)
    assert len(store._snapshots("a")) == 2 and pairs(store.load("a")) == [("a", 3)]
    store.forget(1)
    assert store._numbers() == [3] and pairs(store.load("a")) == [("a", 3)] and pairs(store.load("b")) == [("b", 0)]
    store.save("a", items(spark, ("a", 9)))
    assert store._numbers() == [3, 4]


def test_kept_rows(spark, store):
    rnd, kept, truth = random.Random(4), Kept("k", "owner string, name string, n int", ("owner",), "name", 8), {}
    for step in range(5):
        owners = [f"o{rnd.randrange(6)}" for _ in range(3)]
        new = {o: [(o, f"n{rnd.randrange(12)}", k) for k in range(rnd.randrange(4))] for o in set(owners[:2])}
        truth = {o: r for o, r in truth.items() if o not in owners} | new
        rows = spark.createDataFrame([r for rs in new.values() for r in rs], "owner string, name string, n int")
        gone = spark.createDataFrame([(o,) for o in owners], "owner string")
        store.commit(lambda view, rows=rows, gone=gone: kept.delta(view, rows, gone))
        if step == 3:
            store.commit(kept.compact)
            assert len(store.view().folders("k")) == 1
        view = store.view()
        everything = sorted(r for rs in truth.values() for r in rs)
        assert sorted(map(tuple, kept.read(view).collect())) == everything
        some = ["n1", "n5", "none", None]
        assert sorted(map(tuple, kept.read(view, some).collect())) == [r for r in everything if r[1] in some]
        assert sorted(map(tuple, kept.read(view, spark.createDataFrame([(x,) for x in some], "z string")).collect())) == [r for r in everything if r[1] in some]


def test_a_lookup_reads_its_buckets(spark, store):
    kept = Kept("k", "owner string, name string", ("owner",), "name", 16)
    store.commit(lambda view: kept.delta(view, spark.range(500).selectExpr("cast(id as string) owner", "concat('n', id) name"), spark.createDataFrame([], "owner string")))
    plan = kept.read(store.view(), ["n7"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "PushedFilters: [IsNotNull(name), EqualTo(name,n7)" in plan


WORDS = "get user order parse tree node getUserName parseTree HttpServer order_item load save index alpha beta gamma".split()


def document(rnd):
    return " ".join(rnd.choice(WORDS[: rnd.choice((4, len(WORDS)))]) for _ in range(rnd.randrange(12)))


def test_bm25_index_follows_the_documents(spark, store):
    rnd, docs = random.Random(8), {}

    def same(question):
        df = spark.createDataFrame(list(docs.items()), "id string, text string")
        want = [(r.id, round(r.score, 9)) for r in text.bm25(df, question).collect()]
        assert [(r.id, round(r.score, 9)) for r in text_index.search(store.view(), question).collect()] == want

    for step in range(3):
        new = {f"d{rnd.randrange(25)}": document(rnd) for _ in range(9 if step else 20)}
        gone = [f"d{rnd.randrange(25)}" for _ in range(3)] if step else []
        docs = {k: v for k, v in docs.items() if k not in gone} | new
        text_index.update(store, spark.createDataFrame([*new.items(), (None, "get user")], "id string, text string"), spark.createDataFrame([(g,) for g in gone], "id string"))
        same("parse the tree of a user")
    text_index.compact(store)
    assert len(store.view().folders("bm25_postings")) == 1
    same("getUserName order")
    text_index.update(store, spark.createDataFrame([("d1", None), ("d2", "")], "id string, text string"))
    docs |= {"d1": None, "d2": ""}
    same("gamma order get get")
    assert text_index.search(store.view(), "unknownword").count() == 0


def test_bm25_index_of_nothing(spark, store):
    text_index.update(store, spark.createDataFrame([], "id string, text string"))
    assert text_index.search(store.view(), "get").count() == 0


def test_affected_links(spark):
    rnd = random.Random(6)
    rows = [(f"s{k}", f"n{rnd.randrange(9)}" if k % 3 else "crowd", rnd.choice(("class", "function")), f"class X(N{rnd.randrange(4)}): n{rnd.randrange(9)}() n{rnd.randrange(9)} crowd", None) for k in range(70)]
    symbols = spark.createDataFrame(rows, "id string, name string, kind string, raw_code string, signature string")
    new = spark.createDataFrame([("s3",), ("s4",), ("s10",)], "id string")
    every = link.link_names(symbols)
    want = {tuple(r) for r in every.collect() if {r.source, r.target} & {"s3", "s4", "s10"}}
    assert {tuple(r) for r in link.affected_links(symbols, new).collect()} == want


def source(rnd, names):
    out = []
    for k in range(rnd.randrange(4)):
        n = rnd.choice(names)
        if rnd.random() < 0.4:
            out.append(f"class {n.title()}({rnd.choice(names).title()}):\n    def {rnd.choice(names)}(self):\n        return {rnd.choice(names)}()\n")
        elif rnd.random() < 0.2:
            out.append(f'@app.get("/{n}")\ndef {n}():\n    return {rnd.choice(names)}()\n')
        else:
            out.append(f'def {n}():\n    requests.get("http://x/{rnd.choice(names)}")\n    return {rnd.choice(names).title()}() + {rnd.choice(names)}()\n')
    return "\n".join(out)


def _plain(view):
    """The nodes of a view with summaries that are all made anew, and each vector's text against that of its node."""
    nodes, edges = view.load("nodes"), view.load("edges")
    texts = {r.id: r.text or "" for r in summaries.embedding_texts(nodes, edges).collect()}
    assert {r.id: r.document for r in view.load("vectors").collect()} == texts
    return nodes.drop("summary").join(summaries.heuristic_summaries(nodes.drop("summary"), edges), "id")


def test_a_change_makes_few_summaries(spark, store, monkeypatch):
    files = {f"d{k}/f{k}.py": f"def one{k}():\n    return two{k}()\n\ndef two{k}():\n    return {k}\n" for k in range(6)}
    schema = "repo string, path string, content string"
    index.index_all(store, spark.createDataFrame([("r", p, c) for p, c in files.items()], schema))
    nodes = store.load("nodes").drop("last_modified", "modification_count", "summary")
    index.adopt(store, index.Graph(store.load("nodes"), store.load("edges").unionByName(spark.createDataFrame([("r:d1/f1.py", "r:d2/f2.py", "imports"), ("r:d0/f0.py", "r:d2/f2.py", "imports")], "source string, target string, kind string"))))
    asked = []
    plain = summaries.heuristic_summaries
    monkeypatch.setattr(summaries, "heuristic_summaries", lambda n, e, only=None: asked.append({r.id for r in only.collect()} if only is not None else None) or plain(n, e, only))
    changed = spark.createDataFrame([("r", "modified", "d0/f0.py", "d0/f0.py")], "repo string, status string, old_path string, new_path string")
    index.index_incremental(store, changed, spark.createDataFrame([("r", "d0/f0.py", "def one0():\n    return two1()\n")], schema))
    view = store.view()
    # the file and its functions, the one that went, its module, whose member has another size, and the new callee
    assert asked == [{"r:d0/f0.py", "r:d0/f0.py::one0", "r:d0/f0.py::two0", "r:d0/", "r:d1/f1.py::two1"}]
    monkeypatch.undo()
    assert {(r.id, r.summary) for r in view.load("nodes").collect()} == {(r.id, r.summary) for r in _plain(view).collect()}
    assert [(r.source, r.target) for r in view.load("edges").where("kind = 'imports'").collect()] == [("r:d1/f1.py", "r:d2/f2.py")]
    assert nodes.count() == view.load("nodes").count() + 1


def test_incremental_links_equal_a_rebuild(spark, store, monkeypatch):
    monkeypatch.setattr(link, "AMBIGUOUS", 3)  # so that names cross the limit
    monkeypatch.setattr(link.joined_names, "__defaults__", (3,))
    monkeypatch.setattr(link.link_names, "__defaults__", (None, 3))
    rnd, names = random.Random(12), [f"name{k}" for k in range(7)]
    files = {("ab"[k % 2], f"d{k % 3}/f{k}.py"): source(rnd, names) for k in range(10)}
    schema = "repo string, path string, content string"
    frame = lambda fs: spark.createDataFrame([(*k, v) for k, v in fs.items()], schema)
    index.index_all(store, frame(files))

    def state(s):
        view = s.view()
        nodes = {(r.id, r.kind, r.name, r.summary) for r in view.load("nodes").collect()}
        assert nodes == {(r.id, r.kind, r.name, r.summary) for r in _plain(view).collect()}
        nodes = {x for x in nodes if x[1] not in ("module", "repository")}
        return nodes, {(r.source, r.target, r.kind) for r in view.load("edges").where("kind != 'contains'").collect()}

    for _ in range(2):
        changed = {k: source(rnd, names) for k in rnd.sample(sorted(files), 2)}
        added = {("a", f"new{rnd.randrange(99)}.py"): source(rnd, names)}
        gone = [k for k in rnd.sample(sorted(files), 2) if k not in changed]
        files = {k: v for k, v in files.items() if k not in gone} | changed | added
        rows = [(k[0], "modified", k[1], k[1]) for k in changed] + [(k[0], "added", None, k[1]) for k in added] + [(k[0], "deleted", k[1], None) for k in gone]
        index.index_incremental(store, spark.createDataFrame(rows, "repo string, status string, old_path string, new_path string"), frame(changed | added))
        other = Store(spark, shared_dir(spark))
        index.index_all(other, frame(files))
        mine, whole = state(store), state(other)
        assert mine[1] == whole[1]
        assert mine[0] == whole[0]
    assert store.view().tables.keys() >= {"nodes", "edges", "definitions", "mentions"}


def test_calls_follow_changed_endpoints(spark, store, monkeypatch):
    schema = "repo string, path string, content string"
    routes = ["/orders", "api/orders", "users", "/users/{id}", "/x"]
    serve = lambda k, own: "".join(f"@app.get('{r}')\ndef end{k}_{i}():\n    return {i}\n\n" for i, r in enumerate(own))
    ask = lambda own: "".join(f"def ask{i}():\n    requests.get('{u}')\n\n" for i, u in enumerate(own))
    files = {("a", "s0.py"): serve(0, routes[:2]), ("a", "s1.py"): serve(1, routes[2:]), ("b", "c0.py"): ask(["http://h/v1/api/orders", "/orders", "/users/7"]), ("b", "c1.py"): ask(["/x", "/y/users"]), ("b", "c2.py"): ask(["/none"])}
    frame = lambda fs: spark.createDataFrame([(*k, v) for k, v in fs.items()], schema)
    called = lambda s: sorted(tuple(r) for r in s.load("edges").where("kind = 'api_calls'").select("source", "target").collect())
    index.index_all(store, frame(files), vectors=False)
    assert len(called(store)) == 5
    linked, plain = [], link.api_contracts
    monkeypatch.setattr(link, "api_contracts", lambda c, e: linked.append({r.id for r in c.collect()}) or plain(c, e))
    steps = [
        ({("a", "s0.py"): serve(0, ["v1/api/orders", "/orders"])}, [], {"r": "c0"}),  # a longer route comes, one goes
        ({("a", "s2.py"): serve(2, ["/none", "/x"])}, [], {"r": "c1 c2"}),  # a second endpoint of a route
        ({}, [("a", "s1.py")], {"r": "c0 c1"}),
        ({("b", "c3.py"): ask(["/none", "/orders"])}, [("b", "c1.py")], {"r": "c3"}),
    ]
    for new, dead, want in steps:
        rows = [(k[0], "modified" if k in files else "added", k[1] if k in files else None, k[1]) for k in new] + [(k[0], "deleted", k[1], None) for k in dead]
        files = {k: v for k, v in files.items() if k not in dead} | new
        linked.clear()
        index.index_incremental(store, spark.createDataFrame(rows, "repo string, status string, old_path string, new_path string"), frame(new or {("z", "z"): ""}))
        assert {i.split("::")[0].removeprefix("b:").removesuffix(".py") for i in linked[0] if i.startswith("b:")} == set(want["r"].split())
        nodes = store.load("nodes")
        whole = plain(nodes.where("raw_code != ''"), nodes.where("kind = 'api_endpoint'"))
        assert called(store) == sorted({(r.source, r.target) for r in whole.collect()})


def test_a_log_keeps_microseconds(spark, store):
    at = spark.sql("SELECT 'n' AS node_id, TIMESTAMP '2024-05-06 07:08:09.123456' AS ts")
    store.append_log("retrieval_log", at)
    assert store.retrievals().selectExpr("last_retrieved = TIMESTAMP '2024-05-06 07:08:09.123456'").first()[0]
    store.save_session(spark.sql("SELECT 7 AS session_id, current_timestamp() AS created_at, current_timestamp() AS updated_at, '{}' AS data"))
    assert store.load("sessions").first()["session_id"] == "7"


def test_log_folder_is_no_table(store):
    assert snapshots._LOG.startswith("_") and not store.exists("a")
