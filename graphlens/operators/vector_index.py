"""A vector index: inverted lists by trained centroids, read by partition, with exact scores inside.

Centroids come from a bounded sample; every vector goes to the list of its nearest centroid by angle, and the lists are folders of
one table. A search reads the lists nearest to the question. With `exact` it also reads each list whose bound says that it may
hold a better one: no vector is nearer to the question than its centroid is, less the list's widest angle. Zero vectors
have a list of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import dot
from ..sources.shared import materialize
from ..sources.snapshots import Replace, Store, View
from . import vector

#: Vectors that centroids are trained on, at most, and lists, at most; both bound what one process holds.
SAMPLE, LISTS = 50_000, 4_096
_LISTS, _CENTROIDS = "vector_lists", "vector_centroids"
#: Angles are compared with this much to spare for rounding.
_SPARE = 1e-6


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def centroids(x: np.ndarray, k: int, rounds: int = 15, seed: int = 1) -> np.ndarray:
    """k unit centroids of unit rows, by Lloyd's steps on angles; an empty list takes the row that is farthest from its own."""
    rnd = np.random.default_rng(seed)
    c = x[rnd.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = x @ c.T
        own, best = near.argmax(1), near.max(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        far = iter(np.argsort(best))
        for j in np.flatnonzero(np.bincount(own, minlength=len(c)) == 0):
            sums[j] = x[next(far)]
        new = _unit(sums)
        if np.allclose(new, c):
            break
        c = new
    return c


def build(store: Store, vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE, seed: int = 1) -> None:
    """Indexes all of vectors(id, embedding, ...) in one commit. lists: about the root of the number of vectors.

    Null vectors, or with null or non-finite components, are left out. All vectors have one length.
    """
    spark = store.spark
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = materialize(vectors.where("embedding IS NOT NULL").where(~bad))
    zero = dot(F.col("embedding"), F.col("embedding")) == 0
    n = rows.count()
    k = lists or min(LISTS, max(1, math.isqrt(n)))
    got = rows.where(~zero).select("embedding").orderBy(F.xxhash64("embedding", F.lit(seed))).limit(sample).collect()
    c = centroids(_unit(np.array([r[0] for r in got], float)), k, seed=seed) if got else np.zeros((0, 0))
    shared = spark.sparkContext.broadcast(c)

    def assign(batches):
        own = shared.value
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(len(batch), -1)
            if not len(own) or not len(batch):
                best, cos = np.full(len(batch), -1), np.ones(len(batch))
            else:
                near = _unit(x) @ own.T
                best, cos = near.argmax(1), near.max(1)
                none = ~x.any(1)
                best[none], cos[none] = -1, 1.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int32)), pa.array(cos)], names=[*batch.schema.names, "list", "cos"])

    columns = ["embedding", *(x for x in rows.columns if x != "embedding")]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(columns).schema)
    placed = materialize(rows.select(columns).mapInArrow(assign, f"{ddl}, list int, cos double"))
    width = placed.groupBy("list").agg(F.min("cos").alias("cos"), F.count("*").alias("n"))
    known = spark.createDataFrame([(j, [float(v) for v in row]) for j, row in enumerate(c)], "list int, centroid array<double>")
    table = width.join(known, "list", "left").select("list", "centroid", "cos", "n")
    laid = placed.drop("cos").repartition("list", F.pmod(F.xxhash64("embedding"), F.lit(1 + n // (k * 100_000))))
    store.commit(lambda _: {_LISTS: Replace(laid, ("list",)), _CENTROIDS: Replace(table.coalesce(1))})


def _read(view: View, lists: list[int]) -> DataFrame:
    return view.load(_LISTS).where(F.col("list").isin([int(x) for x in lists])).drop("list")


def search(view: View, question: list[float], k: int = 10, probes: int = 8, exact: bool = False, unit: bool = False) -> DataFrame:
    """The k nearest vectors of `probes` lists, or of all with exact, as vector.top_k gives them."""
    q = np.array(question, float)
    norm = np.linalg.norm(q)
    rows = view.load(_CENTROIDS).collect()  # at most LISTS
    column = vector.literal(question)
    angle = {}
    for r in rows:
        cos = 0.0 if r["centroid"] is None or not norm else float(np.clip(np.dot(r["centroid"], q) / norm, -1, 1))
        angle[r["list"]] = math.acos(cos)
    # by a zero question all scores are 0, and the smallest ids win
    first = sorted(angle, key=lambda j: (j < 0, angle[j], j))[: max(1, probes)] if norm else list(angle)
    found = vector.top_k(_read(view, first), column, k)
    if exact and norm:
        held = [r["score"] for r in found.select("score").collect()]
        least = held[-1] if len(held) == k else -2.0
        wide = {r["list"]: math.acos(min(1.0, max(-1.0, r["cos"]))) for r in rows}
        best = lambda j: 0.0 if j < 0 else math.cos(max(0.0, angle[j] - wide[j] - _SPARE))
        more = [j for j in angle if j not in first and best(j) >= least - _SPARE]
        found = vector.top_k(_read(view, first + more), column, k)
    return found.withColumn("score", (1 + F.col("score")) / 2) if unit else found
