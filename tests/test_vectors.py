"""Embeddings in indexing, hydration and the vector index."""

import random

import pytest
from pyspark.sql import functions as F

from graphlens.operators import embed, vector, vector_index
from graphlens.plans import index
from graphlens.sources.shared import shared_dir
from graphlens.sources.snapshots import Store

TOPICS = {
    "orders": "order cart checkout invoice payment refund price basket", "parser": "token grammar parse lexer syntax tree node rule",
    "network": "socket packet server client retry timeout connect host", "storage": "disk block file write read cache flush index",
}
COMMON = "get set value name return self data list item new the and for with function class".split()


def labelled(seed=1, n=120):
    rnd, rows = random.Random(seed), []
    for k in range(n):
        label = rnd.choice(sorted(TOPICS))
        words = [rnd.choice(TOPICS[label].split()) for _ in range(6)] + [rnd.choice(COMMON) for _ in range(30)]
        rnd.shuffle(words)
        rows.append((f"t{k}", " ".join(words), label))
    return rows


def right_neighbours(vectors, labels):
    """Share of texts whose nearest other text has their label."""
    rows = {r.id: r.embedding for r in vectors.collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    good = 0
    for i, v in rows.items():
        best = max((j for j in rows if j != i), key=lambda j: dot(v, rows[j]) / ((dot(v, v) * dot(rows[j], rows[j])) ** 0.5 or 1))
        good += labels[best] == labels[i]
    return good / len(rows)


def test_neighbours_are_better_than_hashing(spark):
    rows = labelled()
    df = spark.createDataFrame(rows, "id string, text string, label string").repartition(3)
    labels = {r[0]: r[2] for r in rows}
    ours = right_neighbours(embed.embed(df, embed.fit(df)), labels)
    hashed = right_neighbours(df.select("id", vector.hashing_embedding(F.col("text"), embed.SIZE).alias("embedding")), labels)
    assert ours > 0.9 and ours > hashed + 0.1


def test_odd_texts(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "common"), ("d", "common word"), ("d", "common word"), ("e", "é ! ?")], "id string, text string")
    model = embed.fit(df)
    got = {r.id: r.embedding for r in embed.embed(df, model).collect()}
    assert set(got) == set("abcde") and not any(got["a"]) and not any(got["b"]) and not any(got["e"])
    assert abs(sum(x * x for x in got["d"]) - 1) < 1e-5
    assert embed.embed(df.limit(0), model).count() == 0 and embed.fit(df.limit(0)).count() == 0
    again = {r.id: r.embedding for r in embed.embed(df.repartition(4), model).collect()}
    assert all(abs(x - y) < 1e-6 for k in got for x, y in zip(got[k], again[k], strict=True))


def test_vectors_are_kept_by_indexing(spark):
    store = Store(spark, shared_dir(spark))
    schema = "repo string, path string, content string"
    files = spark.createDataFrame([("r", "one.py", "def parse_tree(grammar):\n    return token\n"), ("r", "two.py", "def open_socket(host):\n    return connect\n")], schema)
    index.index_all(store, files)
    first = {r.id: (r.embedding, r.document) for r in store.load("vectors").collect()}
    assert set(first) == {r.id for r in store.load("nodes").collect()} and all(len(v) == embed.SIZE for v, _ in first.values())
    assert index.hydrate(store) == 0 and store.view().number == 0
    q = embed.question(spark, "where is the grammar parsed to a tree", store.load("embedding_model"))
    assert vector.top_k(store.load("vectors").where("kind = 'function'"), q, 1).first().id == "r:one.py::parse_tree"
    store.delete("vectors", spark.createDataFrame([("r:one.py::parse_tree",)], "id string"))
    assert index.hydrate(store) == 1  # only what is missing
    assert {r.id: (r.embedding, r.document) for r in store.load("vectors").collect()} == first
    changed = spark.createDataFrame([("r", "modified", "two.py", "two.py")], "repo string, status string, old_path string, new_path string")
    index.index_incremental(store, changed, spark.createDataFrame([("r", "two.py", "def close_socket(host):\n    return 1\n")], schema))
    after = {r.id: (r.embedding, r.document) for r in store.load("vectors").collect()}
    assert set(after) == {r.id for r in store.load("nodes").collect()}
    assert after["r:one.py::parse_tree"] == first["r:one.py::parse_tree"] and "r:two.py::close_socket" in after and "r:two.py::open_socket" not in after
    plain = Store(spark, shared_dir(spark))
    index.index_all(plain, files, vectors=False)
    assert not plain.exists("vectors") and index.hydrate(plain) == len(first)


@pytest.fixture(scope="module")
def clustered(spark):
    rnd = random.Random(3)
    centres = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(30)]
    rows = [(k, [c + rnd.gauss(0, 0.45) for c in rnd.choice(centres)], k % 3) for k in range(1500)]
    rows += [(2000 + k, rows[5][1], 1) for k in range(5)] + [(3000, [0.0] * 16, 1), (3001, None, 1), (3002, [float("nan")] * 16, 2)]
    return spark.createDataFrame(rows, "id long, embedding array<float>, label int").repartition(4)


def test_index_against_all(spark, clustered):
    store = Store(spark, shared_dir(spark))
    vector_index.build(store, clustered, lists=30)
    view = store.view()
    good = clustered.where("id < 3000")
    asked = [r.embedding for r in good.where("id % 100 = 7").collect()]
    hits = total = 0
    for q in asked:
        want = [(r.id, round(r.score, 9)) for r in vector.top_k(clustered.where("id <= 3000"), vector.literal(q)).select("id", "score").collect()]
        near = {r.id for r in vector_index.search(view, q, probes=4).select("id").collect()}
        hits, total = hits + len(near & {i for i, _ in want}), total + len(want)
        if q is asked[0] or q is asked[-1]:
            assert [(r.id, round(r.score, 9)) for r in vector_index.search(view, q, probes=1, exact=True).select("id", "score").collect()] == want
    assert hits / total >= 0.9
    far = [-x for x in asked[0]]
    want = [r.id for r in vector.top_k(clustered.where("id <= 3000"), vector.literal(far), 1600).select("id").collect()]
    assert [r.id for r in vector_index.search(view, far, 1600, exact=True).select("id").collect()] == want  # all of them
    plan = vector_index._read(view, [1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan


def test_recall_on_the_embeddings(spark):
    data = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id id", "embedding")
    store = Store(spark, shared_dir(spark))
    vector_index.build(store, data)
    hits = 0
    for r in data.where("id % 200 = 0").orderBy("id").collect():
        want = {x.id for x in vector.top_k(data, vector.literal(r.embedding)).select("id").collect()}
        hits += len(want & {x.id for x in vector_index.search(store.view(), list(r.embedding), probes=24).select("id").collect()})
    assert hits >= 0.9 * 100


def test_index_of_nothing(spark, clustered):
    store = Store(spark, shared_dir(spark))
    vector_index.build(store, clustered.limit(0))
    assert vector_index.search(store.view(), [1.0] * 16).count() == 0
    vector_index.build(store, clustered.where("id >= 3000"))
    assert [r.id for r in vector_index.search(store.view(), [1.0] * 16, exact=True).collect()] == [3000]


def test_a_store_is_asked(spark):
    from graphlens.plans import search

    store = Store(spark, shared_dir(spark))
    schema = "repo string, path string, content string"
    code = {("a", "parse/tree.py"): "def parse_tree(grammar):\n    return build_node(grammar)\n\ndef build_node(rule):\n    return rule\n", ("b", "net/socket.py"): "def open_socket(host):\n    return connect(host)\n\ndef connect(host):\n    return host\n"}
    frame = lambda c: spark.createDataFrame([(*k, v) for k, v in c.items()], schema)
    index.index_all(store, frame(code))
    assert search.index_texts(store) == store.load("nodes").count() and search.index_texts(store) == 0
    best = lambda q, **kw: [r.id for r in search.ask(store, q, **kw).orderBy(F.desc("score"), "ord").collect()]
    assert "a:parse/tree.py::parse_tree" in best("where is parse_tree defined")[:3]  # its file may come first
    assert "b:net/socket.py::open_socket" in best("where is open_socket defined")[:3]
    inside = best("where is open_socket defined", repos=["a"])
    assert inside and "b:net/socket.py::open_socket" not in inside  # seeds come from the named repositories
    assert best("where is open_socket defined", repos=["none"]) == []
    changed = spark.createDataFrame([("b", "modified", "net/socket.py", "net/socket.py")], "repo string, status string, old_path string, new_path string")
    index.index_incremental(store, changed, frame({("b", "net/socket.py"): "def close_channel(host):\n    return host\n"}))
    assert 0 < search.index_texts(store) < store.load("nodes").count()
    view = store.view()
    nodes = view.load("nodes")
    hits = lambda q: [(r.id, round(r.score, 9)) for r in q.collect()]
    from graphlens.operators import text, text_index

    for q in ("close_channel host", "parse a rule"):
        assert hits(text_index.search(view, q)) == hits(text.bm25(search.node_texts(nodes), q))
    assert "b:net/socket.py::close_channel" in best("where is close_channel defined")[:3]
