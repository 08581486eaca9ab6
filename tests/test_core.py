import fnmatch
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from graphlens.functions.expressions import glob_regex, normalize_route, split_name
from graphlens.operators import catalog, graph, guardrails, link, quality, sessions, temporal, text, vector
from graphlens.plans.adapters import edges as star_edges
from graphlens.plans.adapters import nodes as star_nodes
from graphlens.plans.queries import QUERIES
from graphlens.plans.search import budget_prefix, fit, ordered, search
from graphlens.sources import config, parse
from graphlens.sources.snapshots import Store
from graphlens.streaming import changes


@pytest.mark.parametrize("pattern", ["*/domain/*", "src/**", "a_b?.py", "[!x]*.go", "*[05]", "a.b"])
def test_globs_as_fnmatch(pattern):
    for path in ("src/domain/x", "domain/x", "a_b1.py", "axb1.py", "x.go", "y.go", "C10", "C11", "a.b", "axb", "src/a\nb"):
        assert bool(re.search(glob_regex(pattern), path)) == fnmatch.fnmatchcase(path, pattern), path


def test_routes_and_names(spark):
    urls = [("http://h/Orders/12?x=1", "/orders/{_}"), ("/users/:id/", "/users/{_}"), ("/a/{b}/c", "/a/{_}/c"), ("https://h", "/"), ("/", "/"), ("/v1/X#f", "/v1/x")]
    got = spark.createDataFrame(urls, "u string, want string").select("want", normalize_route(F.col("u")).alias("got")).collect()
    assert all(r.want == r.got for r in got)
    names = spark.createDataFrame([("HomeView",), ("XMLParser",), ("get_user-name",)], "n string").select(F.array_sort(split_name(F.col("n"))).alias("w")).collect()
    assert [r.w for r in names] == [["home", "view"], ["parser", "xml"], ["get", "name", "user"]]


def _edges(spark, rows):
    return spark.createDataFrame([(a, b, k, 1.0, s) for a, b, k, s in rows], "source string, target string, kind string, weight double, seq long")


def _nodes(spark, ids, kind="function"):
    return spark.createDataFrame([(x, x[0], kind, x, f"src/{x}.py", k) for k, x in enumerate(ids)], "id string, repo string, kind string, name string, path string, seq long")


def test_edges(spark):
    e = _edges(spark, [("a", "b", "calls", 1), ("a", "b", "uses_type", 2), ("a", "zz", "calls", 1), ("b", "a", "contains", 0)])
    n = _nodes(spark, ["a", "b"])
    assert graph.valid_edges(e, n).count() == 3
    assert {(r.source, r.kind) for r in graph.simple_edges(graph.valid_edges(e, n)).collect()} == {("a", "uses_type"), ("b", "contains")}
    assert {r.id: (r.ca, r.ce) for r in graph.coupling(n, graph.valid_edges(e, n)).collect()} == {"a": (0, 2), "b": (2, 0)}


def test_impact_leaves_imports_out_of_the_first_hop(spark):
    e = _edges(spark, [("a", "t", "calls", 0), ("b", "t", "imports", 0), ("c", "a", "imports", 0)])
    got = {r.id: r.hop for r in graph.impact(e, spark.createDataFrame([("t",)], "id string"), 3).collect()}
    assert got == {"a": 1, "c": 2}


def test_shortest_path_and_cycles(spark):
    e = _edges(spark, [("a", "b", "imports", 0), ("b", "d", "imports", 0), ("a", "c", "imports", 0), ("c", "d", "imports", 0), ("d", "d2", "imports", 0)])
    assert [(r.source, r.target) for r in graph.shortest_path(e, "a", "d2").orderBy("ord").collect()] == [("a", "b"), ("b", "d"), ("d", "d2")]
    assert graph.shortest_path(e, "d2", "a").count() == 0
    new = _edges(spark, [("d", "a", "imports", 0), ("x", "x", "imports", 0)])
    assert {tuple(r.cycle) for r in graph.new_cycles(e, new, ["imports"], 4).collect()} == {("a", "b", "d"), ("a", "c", "d"), ("x",)}
    ring = _edges(spark, [(f"n{k:02d}", f"n{k + 1:02d}", "imports", 0) for k in range(14)] + [("n03", "out", "imports", 0)])
    assert len(graph.shortest_path(ring, "n00", "n14").collect()) == 14
    back = _edges(spark, [("n14", "n00", "imports", 0)])
    assert [len(r.cycle) for r in graph.new_cycles(ring, back, ["imports"]).collect()] == [15]
    assert graph.new_cycles(ring, back, ["imports"], 14).count() == 0


def test_expansion_takes_the_best_parent_and_the_gate(spark):
    n = _nodes(spark, ["s", "p", "q", "x", "low"])
    e = _edges(spark, [("s", "p", "calls", 0), ("s", "q", "calls", 0), ("p", "x", "contains", 0), ("q", "x", "uses_type", 0), ("s", "low", "calls", 0)])
    sim = spark.createDataFrame([("p", 0.9), ("q", 0.8), ("low", 0.1)], "id string, sim double")
    got = {r.id: (round(r.score, 6), r.hop) for r in graph.expand(n, e, spark.createDataFrame([("s", 1.0)], "id string, score double"), sim, 2, 0.3).collect()}
    assert got == {"s": (1.0, 0), "p": (0.9, 1), "q": (0.8, 1), "x": (0.4, 2)}


def test_budget(spark):
    seeds = spark.createDataFrame([("a", 0.9, 100), ("b", 0.8, 40), ("c", 0.7, 30)], "id string, score double, tokens long")
    assert [r.id for r in budget_prefix(seeds, 80).collect()] == ["a"]
    item = lambda i, s, t, **k: {"id": i, "score": s, "tokens": t, "is_seed": False, "summary_tokens": 10, "has_summary": False, "targets": []} | k
    assert fit([item("a", 1, 50, is_seed=True), item("b", 0.1, 50, has_summary=True)], 60) == [("a", False), ("b", True)]
    assert fit([item("a", 1, 50, is_seed=True), item("b", 0.1, 50)], 60) == [("a", False)]
    assert fit([item("a", 1, 50, targets=["b"], is_seed=True), item("b", 0.1, 50), item("c", 0.5, 50)], 100) == [("a", False), ("b", False)]
    assert fit([item("a", 1, 500, is_seed=True)], 100) == [("a", False)]


def slow_fit(items, budget):
    kept = {x["id"]: dict(x, summarised=False) for x in items}
    while sum(x["tokens"] for x in kept.values()) > budget and (free := [x for x in kept.values() if not x["is_seed"]]):
        pointed = {t for x in kept.values() for t in x["targets"]}
        x = min([x for x in free if x["id"] not in pointed] or free, key=lambda x: (x["score"], x["id"]))
        if x["has_summary"]:
            x["tokens"], x["summarised"] = x["summary_tokens"], True
            if sum(x["tokens"] for x in kept.values()) <= budget:
                break
        del kept[x["id"]]
    return [(x["id"], x["summarised"]) for x in kept.values()]


def test_fit_as_brute_force():
    rnd = random.Random(4)
    for n in range(60):
        ids = [str(k) for k in range(n)]
        items = [{"id": i, "score": rnd.randrange(9) / 9, "tokens": rnd.randrange(16, 90), "is_seed": rnd.random() < 0.1, "summary_tokens": rnd.randrange(16, 40), "has_summary": rnd.random() < 0.4, "targets": rnd.choices(ids, k=rnd.randrange(3))} for i in ids]
        budget = rnd.randrange(1, 40 * n + 2)
        assert fit(items, budget) == slow_fit(items, budget)


def test_results_are_fitted_many_in_a_batch():
    import pyarrow as pa

    from graphlens.plans import search as plan

    rnd = random.Random(9)
    rows = []
    for q in (None, 1, 2, 2, 3, 4, 5):
        rows += [{"query_id": q, "id": f"{len(rows)}-{k}", "score": rnd.random(), "is_seed": False, "tokens": rnd.randrange(60), "summary_tokens": 3, "has_summary": k % 2 == 0, "targets": []} for k in range(rnd.randrange(1, 9))]
    table, want = pa.Table.from_pylist(rows), []
    for q in (None, 1, 2, 3, 4, 5):
        want += [(q, *x) for x in fit([r for r in rows if r["query_id"] == q], 70)]
    for size in (1, 3, 100):
        calls = list(plan._fitted(iter(table.to_batches(size)), 70))
        assert [tuple(x.values()) for b in calls for x in b.to_pylist()] == want
        assert size < 100 or len(calls) == 2



def test_search_fits_all_rows_and_swaps_for_summaries(spark):
    row = lambda i, kind, name, code, summary, k: (i, "r", kind, name, f"p/{i}", 1, 5, code, summary, None, False, k)
    leaves = [f"leaf{k:03}" for k in range(300)]
    rows = [row("s", "class", "zeta", "zeta", None, 0), row("t", "type", "other", "x", None, 1)] + [row(x, "function", x, "c" * 400, "y", k + 2) for k, x in enumerate(leaves)]
    n = spark.createDataFrame(rows, "id string, repo string, kind string, name string, path string, start_line int, end_line int, raw_code string, summary string, docstring string, has_embedding boolean, seq long")
    e = _edges(spark, [("s", "t", "uses_type", 2)] + [(x, "s", "calls", 1) for x in leaves])
    v = spark.createDataFrame([("s", [1.0, 0.0])], "id string, embedding array<float>")
    docs = spark.createDataFrame([("s", "zeta")], "id string, text string")
    got = {r.id: r.summarised for r in search(n, e, v, docs, "where is zeta defined", vector.literal([1.0, 0.0]), budget=200).collect()}
    # the type scores less than 300 leaves, but the seed points to it; two leaves fit, one by its summary
    assert {"s", "t"} <= set(got) and len(got) == 4 and sum(got.values()) == 1


def test_order(spark):
    m = spark.createDataFrame([("t", "type", 0.1, 0), ("c", "config", 0.9, 1), ("f", "function", 0.5, 2), ("g", "function", 0.7, 3)], "id string, kind string, score double, seq long")
    assert [r.id for r in ordered(m, _edges(spark, [("g", "f", "calls", 0)])).orderBy("ord").collect()] == ["t", "c", "f", "g"]


def test_bm25_floors_common_terms(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma"), (3, "alpha alpha")], "id long, text string")
    got = {r.id: r.score for r in text.bm25(docs, "gamma").collect()}
    assert got == {2: 1.0}
    assert {r.id for r in text.bm25(docs, "alpha beta").collect()} >= {1}


def test_matches_and_intent(spark):
    n = spark.createDataFrame([("a", "HomeView", "x"), ("b", "Other", "src/home/z"), ("c", "No", None)], "id string, name string, path string")
    assert {r.id: round(r.score, 3) for r in text.name_match(n, "show the home view").collect()} == {"a": 0.7, "b": 0.28}
    ends = spark.createDataFrame([("a", "POST", "/orders"), ("b", "GET", "/orders/{id}"), ("c", "GET", "/users")], "id string, http_method string, route_path string")
    for q, want in (("/orders", {"a": 1.0}), ("POST /orders", {"a": 1.2}), ("GET /orders", {"a": 0.6}), ("GET /orders/{x}", {"b": 1.2}), ("no route", {})):
        assert {r.id: r.score for r in text.route_match(ends, q).collect()} == want
    q = spark.createDataFrame([("Where is it?",), ("trace the flow",), ("add a new one",), ("why does it crash",), ("hello",)], "q string")
    assert [r[0] for r in q.select(text.intent(F.col("q"))).collect()] == ["locate", "trace", "write", "debug", "general"]


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0], "alpha"), ("b", [0.0, 1.0], "beta"), ("z", [0.0, 0.0], "beta")], "id string, embedding array<float>, repo string")
    assert [r.id for r in vector.top_k(v, vector.literal([1, 0.1]), 2).collect()] == ["a", "b"]
    assert [r.id for r in vector.top_k(v, vector.literal([1, 0]), 5, {"repo": "beta"}).collect()] == ["b", "z"]
    assert len(spark.range(1).select(vector.hashing_embedding(F.lit("one two"), 16)).first()[0]) == 16


def test_temporal_and_sessions(spark):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    n = spark.createDataFrame([("a", 10, "2024-01-31 00:00:00"), ("b", 10, None), ("c", 0, None)], "id string, modification_count int, m string").withColumn("last_modified", F.col("m").cast("timestamp"))
    assert {r.id: round(r.score, 4) for r in temporal.hotspots(n, now).collect()} == {"a": 0.7, "b": 0.5}
    t = spark.createDataFrame([(k,) for k in (0, 1, 2, 8, 9)], "t int").select(sessions.action(sessions.weight(F.col("t")))).collect()
    assert [r[0] for r in t] == ["drop", "drop", "summary", "summary", "full"]
    q = spark.createDataFrame([("s", 1, [1.0, 0.0]), ("s", 2, [0.0, 1.0])], "session_id string, turn int, vec array<float>")
    assert [round(x, 6) for x in sessions.topic(q).first()["topic"]] == [0.7, 0.3]


def test_topic_and_order_over_many_partitions(spark):
    rnd = random.Random(6)
    rows = [(s, t, [rnd.random(), rnd.random()]) for s in ("a", "b", None) for t in range(50)] + [("gap", 1, [1.0, 2.0]), ("gap", 2, None), ("short", 1, [1.0, 2.0]), ("short", 2, [1.0])]
    q = spark.createDataFrame(rows, "session_id string, turn int, vec array<double>").repartition(7)
    want = {}
    for s, _, v in sorted(rows[:150], key=lambda r: (str(r[0]), r[1])):
        want[s] = [0.3 * x + 0.7 * y for x, y in zip(v, want[s], strict=True)] if s in want else v
    out = sessions.topic(q)
    got = {r.session_id: r.topic for r in out.collect()}
    assert all(got[s] == pytest.approx(want[s]) for s in want) and got["gap"] is None and got["short"] == [pytest.approx(1.0), None] and len(got) == 5
    assert "collect_list(struct(turn" not in out._jdf.queryExecution().toString()
    m = spark.range(500).select(F.col("id").cast("string").alias("id"), F.lit("function").alias("kind"), (F.col("id") % 7).cast("double").alias("score"), F.col("id").alias("seq"))
    ranked = ordered(m, _edges(spark, [("1", "3", "calls", 0)]))
    assert [int(r.id) for r in ranked.orderBy("ord").collect()] == sorted(range(500), key=lambda k: (k != 3, -(k % 7), k)) and "Window" not in ranked._jdf.queryExecution().toString()
    assert ordered(m.limit(0), _edges(spark, []).limit(0)).count() == 0


def test_rules(spark, tmp_path):
    n = _nodes(spark, ["a", "b"])
    e = _edges(spark, [("a", "b", "imports", 0), ("a", "ext/lib.py", "imports", 0)])
    assert guardrails.dependency_ban(n, e, "src/a*", "src/*").count() == 1
    assert guardrails.dependency_ban(n, e, "src/a*", "ext/*").count() == 1
    v = spark.createDataFrame([("r1", "block"), ("r2", "block"), ("r3", "info")], "rule_id string, severity string")
    row = guardrails.verdict(guardrails.approve(v, F.array(F.lit("r1")))).first()
    assert (row["blocks"], row["pending"], row["passed"]) == (2, 1, False)
    m = spark.createDataFrame([(1, "x\nApproved-Rules: a, b,,\napproved-rules: c\nApproved-Reason: why\nApproved-Reason: \n"), (2, "nothing")], "id int, message string")
    assert {r.id: (r.rule_ids, r.reason) for r in guardrails.approvals(m).collect()} == {1: (["a", "b", "c"], "why"), 2: ([], "")}
    good = tmp_path / "r.yaml"
    good.write_text("rules:\n- {id: a, type: metric_threshold, description: d, severity: block, config: {metric: instability, threshold: 0.5}}\n")
    assert config.rules_table(spark, config.read_rules(str(good))).count() == 1
    for bad in ("rules: 1", "x: []", "rules: [{id: a}]", "rules:\n- {id: a, type: cycle_detection, description: d, severity: block, config: {scope: no}}", ":::"):
        good.write_text(bad)
        with pytest.raises(config.ConfigError):
            config.read_rules(str(good))


def test_diff(spark):
    diff = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -10,2 +10,3 @@\n a\n+from m import y\n-old\n@@ -30 +32 @@\n+z\ndiff --git a/n.py b/n.py\nnew file mode 100644\n--- /dev/null\n+++ b/n.py\n@@ -0,0 +1,2 @@\n+def f():\n+  pass"
    rows = parse.diff_hunks(spark.createDataFrame([(1, diff)], "id int, diff string")).orderBy("file_seq", "hunk_start").collect()
    assert [(r.new_path, r.status, r.hunk_start, r.hunk_end, r.added, r.removed) for r in rows] == [
        ("x.py", "modified", 10, 13, ["from m import y"], ["old"]), ("x.py", "modified", 32, 33, ["z"], []), ("n.py", "added", 1, 3, ["def f():", "  pass"], []),
    ]
    lines = ["import a from 'mod'", "const x = require('y')", "from p.q import r", "import os", "x = 1"]
    got = spark.createDataFrame([(x,) for x in lines], "l string").select(parse.import_target(F.col("l"))).collect()
    assert [r[0] for r in got] == ["mod", "y", "p.q", "os", None]


def test_parsing_and_linking(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg/a.py").write_text('class Base:\n    def run(self):\n        pass\n\nclass Child(Base):\n    """Doc"""\n\ndef helper():\n    return Child()\n')
    (tmp_path / "pkg/b.swift").write_text("public func go() {\n  x\n}\nstruct S : Base {\n}\n")
    (tmp_path / "skip.md").write_text("text")
    files = parse.walk(spark, f"file://{tmp_path}", "r", excluded=("*.lock",))
    s = parse.symbols(files)
    assert {(r.name, r.kind) for r in s.collect()} == {("Base", "class"), ("run", "method"), ("Child", "class"), ("helper", "function"), ("go", "function"), ("S", "class")}
    assert [r.path for r in parse.modules(files).collect()] == ["pkg"]
    named = s.select(F.concat_ws("::", "path", "name").alias("id"), "name", "kind", F.col("code").alias("raw_code"), "signature")
    links = {(r.source.split("::")[1], r.target.split("::")[1], r.kind) for r in link.link_names(named).collect()}
    assert links == {("Child", "Base", "inherits"), ("S", "Base", "inherits"), ("helper", "Child", "uses_type"), ("Base", "run", "calls")}


def test_contracts_by_the_end_of_a_route(spark):
    callers = spark.createDataFrame([("x", "r", "fetch('http://h/api/orders')"), ("y", "r", "fetch('/v1/users')"), ("z", "r", "fetch('/v1/myorders')"), ("w", "r", "fetch('/b/c/d')")], "id string, repo string, raw_code string")
    ends = spark.createDataFrame([("e0", "r", "c/d", 4), ("e1", "q", "orders", 1), ("e2", "q", "/v1/users", 2), ("e3", "p", "users", 0), ("e4", "q", "d", 5), ("e5", "q", "orders/", 6)], "id string, repo string, route_path string, seq long")
    # an equal route goes first; of routes at the end the first inserted one counts, even if it lies in the caller's repository
    assert {(r.source, r.target, r.url) for r in link.api_contracts(callers, ends).collect()} == {("x", "e5", "http://h/api/orders"), ("y", "e2", "/v1/users")}
    routes = spark.createDataFrame([("a", None, "/api//orders"), ("b", None, "/api/orders")], "id string, http_method string, route_path string")
    assert [r.id for r in text.route_match(routes, "/orders").collect()] == ["a"]


def test_write_context(spark):
    rows = [("f", "file", "src/a.py"), ("g", "file", "src/di/b.py"), ("ft", "file", "t/test_a.py"), ("C", "class", "src/a.py"), ("fn", "function", "src/a.py"), ("I", "type", "src/i.py"), ("S", "class", "src/s.py"), ("W", "function", "src/container.py"), ("V", "function", "src/v.py")]
    n = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "id string, kind string, path string, seq long")
    e = _edges(spark, [("f", "C", "contains", 0), ("f", "fn", "contains", 0), ("C", "I", "implements", 0), ("S", "I", "implements", 0), ("W", "C", "calls", 0), ("V", "C", "calls", 0), ("W", "fn", "calls", 0), ("g", "f", "imports", 0), ("f", "ft", "imports", 0), ("f", "gone", "imports", 0)])
    got = {(r.role, r.id) for r in link.write_context(n, e, n.where("id = 'f'")).collect()}
    assert got == {("symbol", "C"), ("symbol", "fn"), ("interface", "I"), ("sibling", "S"), ("test", "ft"), ("wiring", "W"), ("imports", "ft"), ("imported_by", "g")}


def test_catalog(spark):
    got = {r.name: r.status for r in catalog.drift(spark.createDataFrame([("a",), ("b",)], "name string"), spark.createDataFrame([("b",), ("c",)], "name string")).collect()}
    assert got == {"a": "missing", "b": "ok", "c": "undeclared"}
    imports = spark.createDataFrame([("r", "flask.app"), ("r", "org.junit")], "repo string, name string")
    assert catalog.frameworks(imports).first()["frameworks"] == ["Flask", "JUnit"]


def test_quality_of_a_file_without_children(spark):
    n = spark.createDataFrame([("f", "r", "file", "f", None, None, "code", None, None, True)], "id string, repo string, kind string, name string, start_line int, end_line int, raw_code string, summary string, docstring string, has_embedding boolean")
    row = quality.scores(n, _edges(spark, []).limit(0)).first()
    assert (row.density, row.coverage, round(row.quality, 6)) == (0.0, 1.0, 0.75)


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.save("items", spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int"))
    new = spark.createDataFrame([("b", 3), ("c", 4)], "id string, x int")
    assert [r.id for r in store.missing("items", new).collect()] == ["c"]
    for _ in range(2):
        store.upsert("items", new)
    assert {(r.id, r.x) for r in store.load("items").collect()} == {("a", 1), ("b", 3), ("c", 4)}
    store.delete("items", spark.createDataFrame([("a",)], "id string"))
    assert store.load("items").count() == 2


def test_bursts(spark, tmp_path):
    rows = [("r", "a", "create", f"2024-01-01 00:00:0{k // 2}.{5 * (k % 2)}", k) for k in range(8)] + [("r", "a", "delete", "2024-01-01 00:01:00", 9)]
    e = spark.createDataFrame(rows, "repo string, path string, op string, t string, event_id long").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    assert sorted(r.n for r in changes.debounced(e, "1 second").collect()) == [1, 8]
    assert sorted(r.n for r in changes.batches(e, 1, 2).collect()) == [1, 4, 4]
    assert changes.last_operations(e).first()["op"] == "delete"
    e.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    got = []
    changes.upsert_each_batch(changes.relevant(stream.withColumn("path", F.lit("a.py")), [".py"], [".git"]), lambda df, i: got.append(df.count()), f"{tmp_path}/ck").awaitTermination(60)
    assert sum(got) == 9


SMALL = "/root/testdata/sf0.001"


def test_graph_queries_over_whole_tables(spark):
    e = [(r.source, r.target, r.kind) for r in star_edges(spark, SMALL).collect()]
    n = {r.id: r for r in star_nodes(spark, SMALL).collect()}
    out, up, by = {}, {}, {}
    for a, b, k in e:
        out.setdefault(a, set()).add(b)
        up.setdefault(b, set()).add((a, k))
        by.setdefault(k, set()).add((a, b))
    got = lambda name: QUERIES[name](spark, SMALL).collect()
    reach, front = dict.fromkeys((x for x in n if x.startswith("p:")), 0), [x for x in n if x.startswith("p:")]
    for hop in (1, 2, 3):
        front = {a for x in front for a, k in up.get(x, ()) if k in ("calls", "uses_type") or k == "imports" and hop > 1} - set(reach)
        reach |= dict.fromkeys(front, hop)
    assert {r.id: r.hop for r in got("impact_hops")} == {k: v for k, v in reach.items() if v}
    far, front = dict.fromkeys((x for x in n if x.startswith("c:")), 0), [x for x in n if x.startswith("c:")]
    for hop in (1, 2, 3, 4):
        front = {b for x in front for b in out.get(x, ())} - set(far)
        far |= dict.fromkeys(front, hop)
    assert {r.id: r.hop for r in got("shortest_path_len")} == far
    assert {r.id for r in got("type_context")} == {b for _, b in by["uses_type"]}
    assert sorted((r.source, r.target, r.kind) for r in got("induced_subgraph")) == sorted(x for x in e if n[x[0]].repo == n[x[1]].repo == "ASIA")
    total = {}
    for root in (x for x in n if x.startswith("s:")):
        one = {a for a, k in up.get(root, ()) if k in ("calls", "uses_type")}
        total[root] = len((one | {a for x in one for a, k in up.get(x, ()) if k in ("calls", "uses_type", "imports")}) - {root})
    assert {r.id: r.total for r in got("impact_rule")} == {k: v for k, v in total.items() if v > 10}
    orders = {r.o_orderkey: r.o_custkey for r in spark.read.parquet(f"{SMALL}/orders.parquet").collect()}
    fresh = {(f"p:{r.l_partkey}", f"c:{orders[r.l_orderkey]}") for r in spark.read.parquet(f"{SMALL}/lineitem.parquet").collect() if r.l_orderkey in orders}
    after = {}
    for a, b in by["imports"]:
        after.setdefault(a, set()).add(b)
    want = {}
    for p, c in fresh:
        want[p] = want.get(p, 0) + sum((s, p) in by["calls"] for s in after.get(c, ()))
    assert {r.part: r.cycles for r in got("cycles_new_edges")} == {k: v for k, v in want.items() if v}
    seeds = {x for x in n if x.startswith("s:")}
    assert {r.id for r in got("expand_khop") if r.hop == 0} == seeds
    pointed = {b for a, b, _ in e if a in n and b in n}
    bucket = {x: 0 if r.kind == "type" else 1 if r.kind in ("config", "constant") else 2 if x in pointed else 3 for x, r in n.items()}
    order = sorted(n, key=lambda x: (bucket[x], -(n[x].seq % 13), n[x].seq, x))
    assert [r.id for r in sorted(got("order_buckets"), key=lambda r: r.ord)] == order


def test_text_queries_over_all_languages(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    ids = QUERIES["ident_extract"](spark, SMALL).collect()
    assert {r.doc_id for r in ids} == set(docs)
    names = {k: m[0] if (m := re.search("[A-Za-z]{4,}", t)) else "" for k, t in docs.items() if t}
    few = {x for x in names.values() if list(names.values()).count(x) <= 20}
    words = {k: set(re.findall("[A-Za-z0-9_]+", docs[k])) for k in names}
    want = {(a, b) for a in names for b in names if a != b and names[b] in few and names[b] != names[a] and names[b] in words[a]}
    from graphlens.schemas import KEYWORDS

    assert {(r.source, r.target) for r in QUERIES["crossfile_link"](spark, SMALL).collect()} == {(a, b) for a, b in want if len(names[b]) > 1 and names[b] not in KEYWORDS}
    assert QUERIES["bm25_topk"](spark, SMALL).count() and QUERIES["hybrid_blend"](spark, SMALL).count()


def test_catalogue_entries_and_entities(spark):
    from graphlens.operators import quality

    node = "id string, repo string, kind string, name string, path string, start_line int, end_line int, raw_code string, summary string, docstring string, has_embedding boolean, http_method string, route_path string, seq long"
    rows = [
        ("r1", "My Shop!", "repository", "My Shop!", None), ("f1", "My Shop!", "file", "a.py", "src/a.py"), ("g1", "My Shop!", "function", "go", "src/a.py"), ("e1", "My Shop!", "api_endpoint", "list_orders", "src/a.py"),
        ("e2", "My Shop!", "api_endpoint", "plain", "src/a.py"), ("r2", "pay--ments", "repository", "pay--ments", None), ("f2", "pay--ments", "file", "b.go", "b.go"),
    ]
    full = [(*r, 1, 9, "x", None, None, True, *{"e1": ("GET", "/orders/{id}"), "e2": (None, None)}.get(r[0], (None, None)), k) for k, r in enumerate(rows)]
    nodes = spark.createDataFrame(full, node)
    edges = spark.createDataFrame([("f2", "e1", "api_calls", 0), ("f2", "f1", "imports", 1), ("g1", "f1", "calls", 2)], "source string, target string, kind string, seq long")
    imports = spark.createDataFrame([("My Shop!", "fastapi.routing", 0), ("My Shop!", "os", 1), ("My Shop!", "os", 2)], "repo string, name string, seq long")
    owners = spark.createDataFrame([("My Shop!", "user:ann@x")], "repo string, owner string")
    names = spark.createDataFrame([("My Shop!",), ("pay--ments",), ("nothing",)], "repo string")
    entries = catalog.catalogue(nodes, edges, imports, quality.scores(nodes, edges), owners, names)
    by = {r.repo: r for r in entries.collect()}
    shop, pay, none = by["My Shop!"], by["pay--ments"], by["nothing"]
    assert (shop.owner, shop.kinds, shop.languages, shop.frameworks, shop.top_dependencies, shop.dependents) == ("user:ann@x", {"api_endpoint": 2, "file": 1, "function": 1, "repository": 1}, {"python": 1}, ["FastAPI"], ["os", "fastapi.routing"], ["pay--ments"])
    assert [(a.method, a.path, a.node_id, a.function) for a in shop.apis] == [("GET", "/orders/{id}", "e1", "list_orders"), ("GET", "", "e2", "plain")] and shop.node_id == "r1" and shop.quality > 0
    assert [(d.repo, d.type, d.cnt, [(x.source, x.target) for x in d.evidence]) for d in pay.dependencies] == [("My Shop!", "api_calls", 1, [("f2", "e1")]), ("My Shop!", "imports", 1, [("f2", "f1")])]
    assert (none.owner, none.quality, none.node_id, none.kinds, none.apis, none.dependencies) == ("unknown", 0.0, None, {}, [], [])
    found = {(r.kind, r.name): r for r in catalog.entities(entries).collect()}
    assert set(found) == {("Component", "my-shop"), ("Component", "pay-ments"), ("Component", "nothing"), ("API", "my-shop-get-orders-id"), ("API", "my-shop-get")}
    shop = found["Component", "my-shop"]
    assert (shop.type, shop.tags, shop.provides) == ("service", ["python", "fastapi"], ["api:default/my-shop-get-orders-id", "api:default/my-shop-get"])
    assert (found["Component", "pay-ments"].type, found["Component", "pay-ments"].consumes, found["Component", "pay-ments"].depends_on) == ("library", ["component:default/my-shop"], ["component:default/my-shop"])
    assert found["API", "my-shop-get-orders-id"].owner == "user:ann@x"


def test_session_topic_slows_the_decay(spark):
    from graphlens.operators import sessions, vector

    context = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 8, [0.0, 1.0]), ("b", 8, [1.0, 0.0]), ("c", 8, None), ("d", 0, [1.0, 0.0])], "node_id string, turn int, vec array<double>")
    bundle = spark.createDataFrame([(x,) for x in "abcde"], "node_id string")
    act = lambda **kw: {r.node_id: r.action for r in sessions.dedup(bundle, context, 10, **kw).collect()}
    assert act() == {"a": "summary", "b": "summary", "c": "summary", "d": "full", "e": "full"}
    assert act(question=vector.literal([2.0, 0.0])) == {"a": "summary", "b": "drop", "c": "summary", "d": "summary", "e": "full"}


def test_a_containment_loop_ends(spark):
    from graphlens.operators import graph

    edges = spark.createDataFrame([("a", "b", "contains"), ("b", "c", "contains"), ("c", "a", "contains")], "source string, target string, kind string")
    got = graph.descendants(edges, spark.createDataFrame([("a",)], "id string"), None)
    assert sorted((r.id, r.depth) for r in got.collect()) == [("b", 1), ("c", 2)]


def test_paths_that_end_alike(spark):
    from graphlens.operators import changeset

    paths = spark.createDataFrame([("a/b/c.py",), ("c.py",), ("x/c.py",), ("b/c.py",), ("abc.py",), ("",)], "path string")
    files = spark.createDataFrame([("b/c.py",), ("z/abc.py",), ("c.py",), ("q",)], "file string")
    want = {(p.path, f.file) for p in paths.collect() for f in files.collect() if p.path and (p.path == f.file or p.path.endswith("/" + f.file) or f.file.endswith("/" + p.path))}
    got = [tuple(r) for r in changeset.suffix_pairs(paths, files).collect()]
    assert len(got) == len(want) and set(got) == want


def test_large_levels_of_a_closure_are_not_broadcast(spark, monkeypatch):
    plans, write = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    monkeypatch.setattr(graph, "SMALL", 2)
    edges = _edges(spark, [("r", f"a{k}", "contains", 0) for k in range(4)] + [(f"a{k}", f"b{k}", "contains", 0) for k in range(4)])
    got = graph.descendants(edges, spark.createDataFrame([("r",)], "id string"), 2)
    assert sorted((r.id, r.depth) for r in got.collect()) == [(f"a{k}", 1) for k in range(4)] + [(f"b{k}", 2) for k in range(4)]
    assert "BroadcastHashJoin" in plans[1] and "SortMergeJoin" in plans[2]


def test_sizes_of_impact_in_blocks_and_slices(spark, monkeypatch):
    import random

    from graphlens.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK", 5)
    monkeypatch.setattr(blocks, "SLICE", 20)
    dice = random.Random(3)
    kinds = ("calls", "uses_type", "inherits", "imports", "contains")
    rows = {(f"n{dice.randrange(40)}", f"n{dice.randrange(40)}", dice.choice(kinds), 0) for _ in range(130)}
    n, e = _nodes(spark, [f"n{k}" for k in range(38)]), _edges(spark, sorted(rows))
    start = n.where("id > 'n2'")
    for hops in (2, 3):
        want = graph.impact_counts(graph.impact_roles(n, e, start, hops)).collect()
        got = graph.impact_sizes(n, e, start, hops)
        assert sorted(got.select("target", "callers", "users", "implementers", "transitive", "total").collect()) == sorted(want)
    assert sum(r.transitive for r in want) > 100


def test_neighbours_in_blocks_and_slices(spark, monkeypatch):
    from graphlens.operators import blocks

    monkeypatch.setattr(blocks, "SLICE", 7)
    dice = random.Random(5)
    pick = lambda: f"n{dice.randrange(12)}"
    edges, pairs = {(pick(), pick()) for _ in range(30)}, {(pick(), pick(), pick()) for _ in range(40)}
    got = blocks.reached(spark.createDataFrame(sorted(pairs), "start string, at string, but string"), spark.createDataFrame(sorted(edges), "at string, id string"), 3)
    want = {(a, y) for a, b, but in pairs for x, y in edges if x == b and y != but}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_cycles_are_closed_in_blocks(spark, monkeypatch):
    from graphlens.operators import blocks

    monkeypatch.setattr(blocks, "SLICE", 7)
    monkeypatch.setattr(graph, "closed", lambda paths, edges: blocks.closed(paths, edges, 3))
    dice = random.Random(1)
    pick = lambda: f"n{dice.randrange(12)}"
    old, new = {(pick(), pick()) for _ in range(30)}, {(pick(), pick()) for _ in range(12)}
    every, nodes = old | new, [f"n{k}" for k in range(12)]
    walks = [w for n in (1, 2, 3) for w in itertools.permutations(nodes, n) if w[0] == min(w)]
    ring = lambda w: {(w[k], w[(k + 1) % len(w)]) for k in range(len(w))}
    want = [w for w in walks if ring(w) <= every and ring(w) & new]
    got = graph.new_cycles(*(_edges(spark, sorted((a, b, "imports", 0) for a, b in x)) for x in (old, new)), ["imports"], 3, None)
    assert sorted(tuple(r.cycle) for r in got.collect()) == sorted(want)


def test_terms_of_documents_are_shuffled_once(spark):
    from graphlens.operators import text_index

    docs = spark.createDataFrame([("a", "parseHTTPResponse parse Parse id_of"), ("a", "snake_case"), ("b", "")], "id string, text string")
    terms = text_index._terms(docs)
    assert terms._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    want = {"parsehttpresponse": 1, "parse": 5, "http": 1, "response": 1, "id_of": 1, "id": 1, "of": 1, "snake_case": 1, "snake": 1, "case": 1}
    assert {(r.id, r.term): (r.tf, r.dl) for r in terms.collect()} == {("a", t): (n, sum(want.values())) for t, n in want.items()}
