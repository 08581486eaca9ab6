"""Search: seeds by vector, text, name and route; expansion; budget; order."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import cosine, token_estimate, token_text
from ..operators import embed, graph, quality, text, text_index, vector
from ..schemas import PROFILES, SYMBOL_KINDS
from ..sources.shared import materialize, numbered
from ..sources.snapshots import Store, View


def budget_prefix(seeds: DataFrame, budget: int, share: float = 0.75) -> DataFrame:
    """seeds(id, score, tokens) in order of score while their sum stays within a share of the budget; the first always stays.

    Each token count is at least 16, so no more rows than budget / 16 can fit: only those are ranked in one task.
    """
    most = max(1, int(share * budget) // 16 + 1)
    top = seeds.orderBy(F.desc("score"), "id").limit(most)
    by = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "id")
    ranked = top.withColumn("cum", F.sum("tokens").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rn", F.row_number().over(by))
    return ranked.where((F.col("cum") <= share * budget) | (F.col("rn") == 1)).drop("rn")


def fit(items: list[dict], budget: int) -> list[tuple[str, bool]]:
    """(id, summary only) of the items kept of one result.

    While the result is over its budget, the item of the least score that is no seed, and that no kept item points to if
    there is such a one, falls back to its summary; if that is not enough it goes. Only seeds left ends it.
    """
    kept = {x["id"]: dict(x, summarised=False, targets=set(x["targets"])) for x in items}
    total = sum(x["tokens"] for x in kept.values())
    pointers = Counter(t for x in kept.values() for t in x["targets"])
    rank = lambda x: (x["score"], x["id"])
    free = sorted((rank(x) for x in kept.values() if not x["is_seed"]), reverse=True)
    leaves = [r for r in reversed(free) if not pointers[r[1]]]  # a heap, as it is sorted
    while total > budget:
        while free and free[-1][1] not in kept:
            free.pop()
        if not free:
            break
        x = kept[heapq.heappop(leaves)[1] if leaves else free[-1][1]]
        if x["has_summary"]:
            total += x["summary_tokens"] - x["tokens"]
            x["tokens"], x["summarised"] = x["summary_tokens"], True
            if total <= budget:
                break
        total -= x["tokens"]
        del kept[x["id"]]
        for t in x["targets"]:
            pointers[t] -= 1
            if not pointers[t] and t in kept and not kept[t]["is_seed"]:
                heapq.heappush(leaves, rank(kept[t]))
    return [(x["id"], x["summarised"]) for x in kept.values()]


def fit_budgets(items: DataFrame, budget: int) -> DataFrame:
    """fit() for each query_id of items(query_id, id, score, is_seed, tokens, summary_tokens, has_summary, targets).

    Each eviction depends on those before, so one task fits a whole result; it holds narrow rows and takes n log n steps. Results
    follow one another in a partition, many in a batch.
    """
    kind = items.schema["query_id"].dataType.simpleString()
    names = ["query_id", "id", "score", "is_seed", "tokens", "summary_tokens", "has_summary", "targets"]
    placed = items.select(names).repartition("query_id").sortWithinPartitions("query_id")
    return placed.mapInArrow(lambda batches: _fitted(batches, budget), f"query_id {kind}, id string, summarised boolean")


def _fitted(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """fit() for each run of a query_id; the last run of a batch waits for the next batch, which may go on with it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _starts(batch.column("query_id"))
        if held and (len(starts) > 1 or held[-1].column("query_id")[-1] != batch.column("query_id")[0]):
            same = held[-1].column("query_id")[-1] == batch.column("query_id")[0]
            cut = starts[1] if same else 0
            yield _fit_runs(pa.Table.from_batches([*held, batch.slice(0, cut)]), budget)
            held, batch, starts = [], batch.slice(cut), [x - cut for x in starts if x >= cut]
        if len(starts) > 1:
            yield _fit_runs(pa.Table.from_batches([batch.slice(0, starts[-1])]), budget)
            batch = batch.slice(starts[-1])
        held.append(batch)
    if held:
        yield _fit_runs(pa.Table.from_batches(held), budget)


def _starts(keys: pa.Array) -> list[int]:
    """Where each run of equal keys begins."""
    codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist()]


def _fit_runs(rows: pa.Table, budget: int) -> pa.RecordBatch:
    keys = rows.column("query_id").combine_chunks()
    names = rows.column_names[1:]
    items = [dict(zip(names, x)) for x in zip(*(rows.column(c).to_pylist() for c in names))]
    starts = [*_starts(keys), len(items)]
    places, ids, summarised = [], [], []
    for begin, end in zip(starts, starts[1:]):
        for i, short in fit(items[begin:end], budget):
            places.append(begin)
            ids.append(i)
            summarised.append(short)
    return pa.RecordBatch.from_arrays([keys.take(pa.array(places, pa.int64())), pa.array(ids, pa.string()), pa.array(summarised, pa.bool_())], ["query_id", "id", "summarised"])


def ordered(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members(id, kind, score, seq) with bucket and ord: types, configuration, what others point to, leaves; then by score."""
    pointed = edges.select(F.col("target").alias("id")).distinct().withColumn("p", F.lit(True))
    bucket = F.when(F.col("kind") == "type", 0).when(F.col("kind").isin("config", "constant"), 1).when(F.col("p"), 2).otherwise(3)
    out = members.join(pointed, "id", "left").withColumn("bucket", bucket).drop("p")
    return numbered(out, F.col("bucket"), F.desc("score"), F.col("seq"), F.col("id"), name="ord").withColumn("ord", F.col("ord").cast("int"))


def search(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, docs: DataFrame | None, question: str, query_vector: Column, budget: int = 8000, width: int = 3, repos=None, flat: bool = False, hits: DataFrame | None = None) -> DataFrame:
    """The result of one question: id, score, ord, summarised (only the summary fits).

    nodes and edges of a graph, vectors(id, embedding), docs(id, text), or in place of docs the text hits(id, score) themselves. Intent sets the blend, hops and gate. Text hits are
    cut before the repository filter, as the vector search filters before its cut only for a single repository.
    """
    spark = nodes.sparkSession
    intent = spark.range(1).select(text.intent(F.lit(question))).first()[0]
    alpha, hops, gate = PROFILES[intent]
    own = vectors.join(nodes.select("id", "kind", "repo"), "id")
    own = own.where(F.col("repo") == repos[0]) if repos and len(repos) == 1 else own
    seeds = vector.top_k(own, query_vector, 20).select("id", "score") if flat else vector.beam(own, query_vector, SYMBOL_KINDS, width).select("id", "score")
    in_repo = (lambda df: df.join(nodes.where(F.col("repo").isin(*repos)).select("id"), "id", "left_semi")) if repos else (lambda df: df)
    seeds = in_repo(seeds)
    seeds = materialize(seeds)
    if not seeds.limit(1).count():
        return spark.createDataFrame([], "id string, score double, ord int, summarised boolean")
    blended = text.blend(seeds, in_repo(text.bm25(docs, question, 3 * width) if hits is None else hits), alpha)
    blended = text.raise_scores(blended, in_repo(text.name_match(nodes, question)))
    if "route_path" in nodes.columns:
        blended = text.raise_scores(blended, in_repo(text.route_match(nodes.where("kind = 'api_endpoint'"), question)))
    both = (F.coalesce("raw_code", F.lit("")) != "") & (F.coalesce("summary", F.lit("")) != "")
    size = lambda x: token_estimate(x).cast("long")
    tokens = nodes.select("id", size(token_text(F.col("raw_code"), F.col("summary"))).alias("tokens"), size(F.coalesce("summary", F.lit(""))).alias("summary_tokens"), both.alias("has_summary"))
    kept = budget_prefix(blended.join(tokens, "id"), budget).select("id", "score")
    kept = materialize(kept)
    similarity = vectors.select("id", cosine(F.col("embedding"), query_vector).alias("sim"))
    grown = graph.expand(nodes, edges, kept, similarity, hops, gate)
    for kind, score in (("uses_type", 0.3), ("reads_config", 0.2)):
        grown = grown.unionByName(graph.context_of(edges, grown, kind, score).withColumn("hop", F.lit(hops + 1)))
        grown = materialize(grown)
    near = materialize(graph.induced(edges, grown).select("source", "target"))
    touching = edges.join(grown.select(F.col("id").alias("source")), "source", "left_semi").unionByName(edges.join(grown.select(F.col("id").alias("target")), "target", "left_semi")).distinct()
    good = quality.scores(nodes.join(grown.select("id"), "id", "left_semi"), touching).select("id", "quality")
    good = materialize(good)
    scored = materialize(grown.join(good, "id").join(nodes.select("id", "kind", "seq"), "id").join(tokens, "id").withColumn("score", 0.85 * F.coalesce("score", F.lit(0.5)) + 0.15 * F.col("quality")))
    targets = near.groupBy(F.col("source").alias("id")).agg(F.collect_set("target").alias("targets"))
    items = scored.join(targets, "id", "left").select(
        F.lit(question).alias("query_id"), "id", "score", (F.col("hop") == 0).alias("is_seed"), "tokens", "summary_tokens", "has_summary",
        F.coalesce("targets", F.array().cast("array<string>")).alias("targets"),
    )
    final = materialize(scored.join(fit_budgets(items, budget).select("id", "summarised"), "id"))
    return ordered(final.select("id", "kind", "score", "seq", "summarised"), graph.induced(near, final)).select("id", "score", "ord", "summarised")


def node_texts(nodes: DataFrame) -> DataFrame:
    """id, text that keywords are looked for in: a node's code, else its summary, else its name."""
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    return nodes.select("id", F.coalesce(filled("raw_code"), filled("summary"), F.col("name")).alias("text"))


_TEXTS = "id string, sha string"


def index_texts(store: Store) -> int:
    """Brings the store's BM25 index to the texts of its nodes, in one commit; how many texts were new or changed."""
    made = []

    def change(view: View) -> dict:
        now = materialize(node_texts(view.load("nodes")).where("text IS NOT NULL").withColumn("sha", F.sha2("text", 256)))
        before = view.load("bm25_texts", _TEXTS)
        docs = materialize(now.join(before, ["id", "sha"], "left_anti").select("id", "text"))
        gone = materialize(before.join(now, "id", "left_anti").select("id"))
        made[:] = [docs.count()]
        if not made[0] and not gone.limit(1).count():
            return {}
        return {**text_index.changed(view, docs, gone), "bm25_texts": now.select("id", "sha")}

    store.commit(change)
    return made[0]


def ask(store: Store, question: str, budget: int = 8000, width: int = 3, repos=None, flat: bool = False) -> DataFrame:
    """search() over what a store keeps: its graph, its vectors and their model, and its BM25 index, all of one commit."""
    view = store.view()
    vectors = view.load("vectors")
    nodes = view.load("nodes").join(vectors.select("id", F.lit(True).alias("has_embedding")), "id", "left").withColumn("has_embedding", F.coalesce("has_embedding", F.lit(False)))
    query_vector = embed.question(store.spark, question, view.load("embedding_model"))
    hits = materialize(text_index.search(view, question, 3 * width))
    return search(materialize(nodes), view.load("edges"), vectors.select("id", "embedding"), None, question, query_vector, budget, width, repos, flat, hits)
