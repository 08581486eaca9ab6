"""Change sets, rules, reports, summaries, indexing and snapshots against small fixtures."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from graphlens.functions.expressions import map_from_json, map_to_json, node_class, rounded, symbol_kind
from graphlens.operators import catalog, changeset, graph, guardrails, link, quality, reports, sessions, summaries
from graphlens.plans import index
from graphlens.sources import parse, shared
from graphlens.sources.config import read_repositories, read_settings
from graphlens.sources.snapshots import Store
from graphlens.streaming import changes

NODE = "id string, repo string, kind string, name string, path string, start_line int, end_line int, raw_code string, summary string, signature string, docstring string, http_method string, route_path string, seq long"


def nodes_of(spark, *rows):
    names = [x.split()[0] for x in NODE.split(", ")]
    return spark.createDataFrame([tuple({"seq": k, **r}.get(c) for c in names) for k, r in enumerate(rows)], NODE)


def edges_of(spark, *rows):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "source string, target string, kind string, seq long")


@pytest.fixture(scope="module")
def world(spark):
    n = nodes_of(
        spark,
        {"id": "r", "repo": "r", "kind": "repository", "name": "r"}, {"id": "m", "repo": "r", "kind": "module", "name": "src", "path": "src"},
        {"id": "f", "repo": "r", "kind": "file", "name": "a.py", "path": "src/a.py", "start_line": 1, "end_line": 99},
        {"id": "g", "repo": "r", "kind": "function", "name": "go", "path": "src/a.py", "start_line": 5, "end_line": 9, "raw_code": "def go(): ...", "signature": "def go():", "docstring": "Goes."},
        {"id": "e", "repo": "r", "kind": "api_endpoint", "name": "orders", "path": "src/a.py", "start_line": 20, "end_line": 30, "http_method": "GET", "route_path": "/orders"},
        {"id": "b", "repo": "r", "kind": "file", "name": "b.py", "path": "src/b.py"}, {"id": "h", "repo": "r", "kind": "function", "name": "help", "path": "src/b.py", "start_line": 1, "end_line": 3},
        {"id": "c", "repo": "q", "kind": "class", "name": "Q", "path": "lib/q.py", "start_line": 1, "end_line": 9},
    )
    e = edges_of(spark, ("r", "m", "contains"), ("m", "f", "contains"), ("m", "b", "contains"), ("f", "g", "contains"), ("f", "e", "contains"), ("b", "h", "contains"), ("h", "g", "calls"), ("c", "h", "calls"), ("c", "g", "uses_type"), ("f", "b", "imports"))
    return n, e


DIFF = """diff --git a/src/a.py b/src/a.py
@@ -1,2 +7,2 @@
+from lib.x import y
-import old
 rest
diff --git a/src/b.py b/src/b.py
deleted file mode 100644
diff --git a/lib/new.py b/lib/new.py
new file mode 100644
@@ -0,0 +1,3 @@
+class New:
+    def one(self):
+        pass
"""


@pytest.fixture(scope="module")
def change(spark, world):
    return changeset.analyze(spark.createDataFrame([("d", DIFF)], "id string, diff string"), *world)


def test_change_set(change):
    ids = lambda df: {r.id for r in df.collect()}
    assert ids(change.modified) == {"f", "g", "b", "h"}
    assert {(r.path, r.status) for r in change.files.collect()} == {("src/a.py", "modified"), ("src/b.py", "deleted"), ("lib/new.py", "added")}
    assert {(r.id, r.kind) for r in change.new_nodes.collect()} == {("q:lib/new.py::New", "class"), ("q:lib/new.py::one", "method")}
    assert [tuple(r) for r in change.new_edges.collect()] == [("f", "lib.x", "imports")]
    assert [tuple(r) for r in change.removed_edges.collect()] == [("f", "old", "imports")]


def test_change_of_nothing(spark, world):
    c = changeset.analyze(spark.createDataFrame([], "id string, diff string"), *world)
    assert all(df.count() == 0 for df in (c.files, c.modified, c.new_nodes, c.new_edges, c.removed_edges))


def rule(kind, severity="block", **config):
    return {"id": kind, "type": kind, "description": kind, "severity": severity, "config": config}


def test_rules_and_reports(spark, world, change):
    n, e = world
    rules = [
        rule("dependency_ban", source_pattern="src/*", target_pattern="lib.*"), rule("file_scope_ban", "warning", path_pattern="src/b*"), rule("metric_threshold", "warning", metric="afferent_coupling", threshold=1),
        rule("impact_threshold", max_impact=1), rule("cycle_detection", scope="intra_repo"), rule("metric_threshold", metric="none", threshold=0), rule("unknown"),
    ]
    found = changeset.evaluate(n, e, change, rules)
    assert sorted((r.rule_id, r.severity, r.file_path) for r in found.collect()) == [("dependency_ban", "block", "src/a.py"), ("file_scope_ban", "warning", "src/b.py"), ("impact_threshold", "block", "src/a.py"), ("metric_threshold", "warning", "src/a.py")]
    marked = guardrails.approve(found, F.array(F.lit("dependency_ban")))
    assert not guardrails.verdict(marked).first()["passed"]
    plain = reports.text(reports.rule_report(marked, 7, 3)).first()[0]
    assert plain.startswith("Check failed\n  Rules: 7") and "BLOCK (approved) [dependency_ban]" in plain and "BLOCK (pending) [impact_threshold]" in plain
    table = reports.text(reports.rule_report(marked, 7, 3, markdown=True)).first()[0]
    assert table.count("\n| ") == 5 and "Fixes:" in table
    assert len(reports.rule_json(marked).collect()) == 4
    empty = reports.text(reports.rule_report(marked.limit(0), 1, 0)).first()[0]
    assert empty.startswith("Check passed")


def test_new_cycles_of_a_change(spark, world):
    n, e = world
    c = changeset.analyze(spark.createDataFrame([("d", 'diff --git a/src/b.py b/src/b.py\n@@ -1 +1 @@\n+import "f"')], "id string, diff string"), n, e)
    got = changeset.evaluate(n, e, c, [rule("cycle_detection", scope="intra_repo")]).collect()
    assert [r.message for r in got] == ["Circular dependency: b -> f -> b"]


def test_review_reasons(spark, world, change):
    n, e = world
    asks = [{"type": "impact_count", "threshold": 1}, {"type": "impact_count"}, {"type": "cross_repo"}, {"type": "modifies_api"}]
    assert [r.reason for r in changeset.review_reasons(n, e, change, asks).collect()] == ["g has 2 dependants, over 1"]
    more = changeset.ChangeSet(change.files, n.where("id = 'e'").select("id"), change.new_nodes, edges_of(spark, ("f", "c", "shared_lib")), change.removed_edges)
    assert len(changeset.review_reasons(n, e, more, asks).collect()) == 2


def test_impact_by_role(world):
    n, e = world
    roles = graph.impact_roles(n, e, n.where("id = 'g'"))
    assert sorted((r.role, r.hop, r.id) for r in roles.collect()) == [("caller", 1, "h"), ("user", 1, "c")]
    more = graph.impact_roles(n, e, n.where("id = 'h'"))
    assert [(r.role, r.id) for r in more.collect()] == [("caller", "c")]
    counts = graph.impact_counts(roles).first()
    assert (counts.callers, counts.users, counts.implementers, counts.transitive, counts.total) == (1, 1, 0, 0, 2)
    out = reports.text(reports.impact_text(roles, n)).first()[0]
    assert out.split("\n") == ["Impacted: 2", "### Callers", "- `help` (src/b.py)", "### Users", "- `Q` (lib/q.py)"]


def test_summaries_and_embedding_texts(world):
    n, e = world
    s = {r.id: r.summary for r in summaries.heuristic_summaries(n, e).collect()}
    assert s["g"] == "def go():\nGoes.\nCalled by: help" and s["e"] == "Route: GET /orders" and s["c"] == "Q"
    assert s["f"] == "File: src/a.py\n  def go(): — Goes.\n  orders" and s["m"] == "Module: src\n  a.py (2 symbols)\n  b.py (1 symbols)" and s["r"] == "Repository: r\n  src/ (2 files)"
    t = {r.id: r.text for r in summaries.embedding_texts(n, e).collect()}
    assert t["g"] == "def go(): ...\n\n# Context\nFile: src/a.py\nDoc: Goes.\nCalled by: help" and t["f"] == "src/a.py\ndef go():\norders"


def test_other_texts(spark, world):
    n, e = world
    bundle = reports.text(reports.bundle_text(n.where("id IN ('g', 'c')").withColumn("ord", F.col("seq")), e)).first()[0]
    assert bundle.startswith("### q\n```python\n# q:lib/q.py (lines 1-9)") and "calls: h" in bundle
    context = link.write_context(n, e, n.where("id = 'f'"))
    assert "### Imports\n- `b.py` file (src/b.py)" in reports.text(reports.context_text(context, n)).first()[0]
    drift = catalog.drift(spark.createDataFrame([("a",), ("b",)], "name string"), spark.createDataFrame([("a",), ("c",)], "name string"))
    assert reports.text(reports.drift_text(drift)).first()[0].startswith("Drift: 66.7%\nConfirmed\n- a")
    rows = catalog.service_rows(n, e)
    assert "Dependencies: r (calls), r (uses_type)" in reports.text(reports.catalog_text(rows, catalog.dependency_map(n, e))).first()[0]
    q = quality.scores(n.withColumn("has_embedding", F.lit(True)), e)
    assert reports.text(reports.quality_text(quality.overview(q), quality.gaps(q))).first()[0].startswith("Nodes: ")
    by = {r.repo: r for r in catalog.quality_by_repository(n, q).collect()}
    assert by["r"].good + by["r"].moderate + by["r"].poor == 7


def test_lookups(spark, world):
    n, _ = world
    assert graph.file_node(n, "a.py").first()["id"] == "f" and graph.file_node(n, "other/b.py").first()["id"] == "b" and graph.file_node(n, "zz.py").count() == 0
    assert [r.id for r in graph.first_named(n, spark.createDataFrame([("r", "go"), ("q", "go")], "repo string, name string")).collect()] == ["g"]
    assert graph.repositories(n).first()["repos"] == ["q", "r"]
    repos = changeset.infer_repositories(n, spark.createDataFrame([("library/x.py",), ("src/z.py",), ("zz",), ("",)], "path string"))
    assert {r.path: r.repo for r in repos.collect()} == {"library/x.py": "q", "src/z.py": "r", "zz": "q", "": "q"}
    one = spark.range(1)
    kinds = one.select(*(node_class(F.lit(t)) for t in ("function_definition", "class_declaration", "impl_item", "comment", "field_declaration", "odd_item", "call")), symbol_kind(F.lit("TYPE")), symbol_kind(F.lit("TYPE"), True)).first()
    assert tuple(kinds) == ("function", "class", "class", None, None, "function", None, "function", "type")
    maps = one.select(rounded(F.lit(0.125), 2), map_to_json(F.create_map(F.lit("a"), F.lit("b"))), map_from_json(F.lit('{"a":"b"}')), map_from_json(F.lit(None).cast("string"))).first()
    assert tuple(maps) == (0.12, '{"a":"b"}', {"a": "b"}, {})


def test_turns_moves_and_sessions(spark, tmp_path):
    context = spark.createDataFrame([("s", 4, "a")], "session_id string, turn int, node_id string")
    new = spark.createDataFrame([("s", 10, "b"), ("s", 10, "c"), ("s", 11, "d"), ("t", 1, "e")], "session_id string, seq int, node_id string")
    got = sessions.record(context, new)
    assert sorted((r.session_id, r.turn, r.node_id) for r in got.collect()) == [("s", 4, "a"), ("s", 5, "b"), ("s", 5, "c"), ("s", 6, "d"), ("t", 1, "e")]
    assert {(r.session_id, r.turns, r.nodes) for r in sessions.state(got).collect()} == {("s", 6, 4), ("t", 1, 1)}
    moved = spark.createDataFrame([("r", "a", "moved", "b"), ("r", "c", "moved", None), ("r", "d", "modified", None)], "repo string, path string, op string, dest string")
    assert sorted((r.path, r.op) for r in changes.moves_as_two(moved).collect()) == [("a", "deleted"), ("b", "created"), ("c", "deleted"), ("d", "modified")]
    day = lambda k: datetime.datetime(2024, 1, k)
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.load("sessions").count() == 0 and store.load("repo_state").count() == 0
    for k in (1, 5, 9):
        store.save_session(spark.createDataFrame([(f"s{k}", day(1), day(k), "{}")], "session_id string, created_at timestamp, updated_at timestamp, data string"))
    now = F.lit(day(13))
    assert [r.session_id for r in store.sessions(now, 9).collect()] == ["s9", "s5"]
    store.purge_sessions(now, 7)
    assert store.count("sessions") == 1
    store.clear("sessions")
    assert store.count("sessions") == 0
    store.append_log("retrieval_log", spark.createDataFrame([("a", day(1)), ("a", day(2))], "node_id string, ts timestamp"))
    assert tuple(store.retrievals().first()) == ("a", day(2), 2)


def test_a_writer_that_fails_leaves_the_old_snapshot(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.save("items", spark.createDataFrame([("a", 1)], "id string, x int"))
    fails = spark.range(3).select(F.raise_error(F.lit("broken")).cast("string").alias("id"), F.lit(1).alias("x"))
    with pytest.raises(Exception, match="broken"):
        store.save("items", fails)
    with pytest.raises(Exception, match="broken"):
        store.upsert("items", fails)
    assert [r.id for r in store.load("items").collect()] == ["a"]
    store.upsert("items", spark.createDataFrame([("b", 2)], "id string, x int"))
    assert store.count("items") == 2
    store.vacuum("items")
    assert store.count("items") == 2 and len(store._snapshots("items")) == 1


def test_scratch_removes_its_tables(spark):
    with shared.scratch(spark):
        path = shared.materialize(spark.range(3)).inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_settings_and_repositories(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text('[indexing]\nmax_file_size_kb = 5\nodd = 1\n[[repos]]\nname = "a"\npath = "sub/../x"\n')
    with pytest.warns(UserWarning, match="odd"):
        assert read_settings(str(path)).max_file_size_kb == 5
    assert read_repositories(str(path)) == [{"name": "a", "path": str(tmp_path / "x"), "language": None}]


def test_indexing_as_a_whole_and_by_changes(spark, tmp_path):
    one = "class Base:\n    def run(self):\n        return 1\n\ndef helper():\n    return Base()\n"
    two = "from one import Base\n\nclass Child(Base):\n    def go(self):\n        return helper()\n"
    files = spark.createDataFrame([("r", "src/one.py", one), ("r", "two.py", two), ("r", "notes.txt", "x"), ("r", "empty.py", "")], "repo string, path string, content string")
    store = Store(spark, f"file://{tmp_path}/s")
    index.index_all(store, files)
    n = {r.id: r for r in store.load("nodes").collect()}
    assert {k: r.kind for k, r in n.items()} == {"r:": "repository", "r:src/": "module", "r:src/one.py": "file", "r:two.py": "file", "r:src/one.py::Base": "class", "r:src/one.py::run": "method", "r:src/one.py::helper": "function", "r:two.py::Child": "class", "r:two.py::go": "method"}
    e = {(r.source, r.target, r.kind) for r in store.load("edges").collect()}
    assert {("r:", "r:src/", "contains"), ("r:src/", "r:src/one.py", "contains"), ("r:", "r:two.py", "contains"), ("r:src/one.py", "r:src/one.py::Base", "contains"), ("r:src/one.py::Base", "r:src/one.py::run", "contains")} < e
    assert {("r:two.py::Child", "r:src/one.py::Base", "inherits"), ("r:two.py::go", "r:src/one.py::helper", "calls")} < e
    assert n["r:src/one.py"].summary.startswith("File: src/one.py\n")
    changed = spark.createDataFrame([("r", "modified", "two.py", "two.py"), ("r", "deleted", "src/one.py", None), ("r", "added", None, "three.py")], "repo string, status string, old_path string, new_path string")
    report = index.index_incremental(store, changed, spark.createDataFrame([("r", "two.py", "def other():\n    return third()\n"), ("r", "three.py", "def third():\n    pass\n")], "repo string, path string, content string")).first()
    assert (report.added, report.modified, report.deleted, report.renamed) == (1, 1, 1, 0)
    ids = {r.id for r in store.load("nodes").where("kind NOT IN ('module', 'repository')").collect()}
    assert ids == {"r:two.py", "r:two.py::other", "r:three.py", "r:three.py::third"}
    assert {(r.source, r.target, r.kind) for r in store.load("edges").where("kind != 'contains'").collect()} == {("r:two.py::other", "r:three.py::third", "calls")}
    assert parse.modules(files).count() == 1
