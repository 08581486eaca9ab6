"""Hard-negative mining with a matrix product in a residue number system.

Vectors become integers. Their residues modulo a few small primes are multiplied as float32 matrices, exactly, as each sum of
a slice of components stays below 2^24; the scores are put together from the residues by Chinese remaindering, signed. There
are as many primes as the largest norm asks for (Cauchy-Schwarz).

Anchors are a stated query set. They are dealt into groups that fit a task, rows into slices; a cell is a group and a slice,
its anchors are read first and its rows stream past them in blocks. A first pass, by label, finds the positives; a second one
finds, for each of them, the negatives within its window of scores. A cell keeps `top` rows for each anchor (and positive), so
what cells give is merged from `top` rows a slice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Components whose products are summed in float32 at once, and the primes: 64 * 510 * 510 < 2^24.
DEPTH = 64
PRIMES = [p for p in range(1021, 900, -2) if all(p % q for q in range(3, 32, 2))]
#: Scores are below this (the bound by the norms is checked).
MOST = 1 << 51
#: Anchors of a group, at most about; rows of a slice, about; anchors and rows multiplied at once.
GROUP, SLICE, TILE, BLOCK = 16_384, 8_192, 512, 2_048
_LOW = np.iinfo(np.int64).min


def primes_for(bound: float) -> list[int]:
    """The first primes whose product is over twice the bound, so that signed scores up to it are told apart."""
    k = next(k for k in range(1, len(PRIMES)) if math.prod(PRIMES[:k]) > 2 * bound + 1)
    return PRIMES[:k]


def residues(x: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """Residues of least magnitude, as float32, for each prime."""
    return [((x + p // 2) % p - p // 2).astype(np.float32) for p in primes]


def multiply(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """a b^T in exact signed integers from residue matrices; mixed radix digits, then the sign."""
    digits: list[np.ndarray] = []
    for x, y, p in zip(a, b, primes, strict=True):
        r = np.zeros((x.shape[0], y.shape[0]), np.int64)
        for k in range(0, x.shape[1], DEPTH):
            r += (x[:, k : k + DEPTH] @ y[:, k : k + DEPTH].T).astype(np.int64)
        for d, q in zip(digits, primes, strict=False):
            r = (r - d) * pow(q, -1, p) % p
        digits.append(r % p)
    out, weight = np.zeros_like(digits[0]), 1
    for d, p in zip(digits, primes, strict=True):
        out += d * weight
        weight *= p
    out[out > weight // 2] -= weight
    return out


class Best:
    """The `top` best (score down, id up) rows for each of n slots."""

    def __init__(self, n: int, top: int):
        self.top = top
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(n, _LOW)  # what a row needs to be among the best of its slot

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = np.concatenate([self.slot, slot]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        by = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[by], score[by], ids[by]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, np.int64)
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.r_[first, len(slot)]))
        self.floor[slot[place == self.top - 1]] = score[place == self.top - 1]
        keep = place < self.top
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]

    def offer(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: a row for each slot, _LOW where a row is no candidate."""
        floor = self.floor[slots]
        if scores.shape[1] > self.top:
            floor = np.maximum(floor, np.partition(scores, -self.top, axis=1)[:, -self.top])
        a, b = np.nonzero((scores >= floor[:, None]) & (scores != _LOW))
        if len(a):
            self.add(slots[a], scores[a, b], ids[b])


def _cells(primes: list[int], top: int, low: int, high: int, unit: int, by_label: bool):
    """Rows (cell, kind, uid, id, label, v, wanted), sorted by cell and kind: anchors, then rows -> uid, place, id, score.

    by_label: positives, else negatives for each of the scores wanted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tiles, n, best = None, [], 0, None

        def close():
            if best is None or not len(best.slot):
                return None
            uid = np.concatenate([t[0] for t in tiles])
            per = 1 if by_label else top
            ids = pa.array(best.id, mask=best.id == np.iinfo(np.int64).max)
            return pa.RecordBatch.from_arrays([pa.array(uid[best.slot // per]), pa.array((best.slot % per).astype(np.int32)), ids, pa.array(best.score)], names=["uid", "place", "id", "score"])

        def numbers(batch, lo, hi):
            part = batch.slice(lo, hi - lo)
            v = part.column("v")
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)
            return part, part.column("uid").to_numpy(), part.column("label").to_numpy(), residues(x, primes)

        for batch in batches:
            cell, kind = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
            edges = np.r_[0, np.flatnonzero((np.diff(cell) != 0) | (np.diff(kind) != 0)) + 1, len(cell)]
            for lo, hi in ((a, b) for s, e in zip(edges[:-1], edges[1:], strict=True) for a in range(s, e, BLOCK) for b in [min(e, a + BLOCK)]):
                if cell[lo] != at:
                    if out := close():
                        yield out
                    at, tiles, n, best = cell[lo], [], 0, None
                if kind[lo] == 0:
                    for a in range(lo, hi, TILE):
                        part, uid, label, res = numbers(batch, a, min(hi, a + TILE))
                        wanted = np.full((len(uid), top), _LOW)
                        if not by_label:
                            for k, scores in enumerate(part.column("wanted").to_pylist()):
                                wanted[k, : len(scores)] = scores
                        tiles.append((uid, label, res, wanted, n))
                        n += len(uid)
                    continue
                if not tiles:
                    continue
                best = best or Best(n * (1 if by_label else top), top)
                part, uid, label, res = numbers(batch, lo, hi)
                ids = part.column("id").fill_null(np.iinfo(np.int64).max).to_numpy()
                for own, own_label, own_res, wanted, first in tiles:
                    scores = multiply(own_res, res, primes)
                    same = own_label[:, None] == label[None, :]
                    slots = first + np.arange(len(own))
                    if by_label:
                        scores[~same | (own[:, None] == uid[None, :])] = _LOW
                        best.offer(slots, scores, ids)
                        continue
                    scores[same] = _LOW
                    for j in range(top):
                        p = wanted[:, j : j + 1]
                        fits = (p != _LOW) & (scores != _LOW) & (low * p <= unit * scores) & (unit * scores <= high * p)
                        if fits.any():
                            best.offer(slots * top + j, np.where(fits, scores, _LOW), ids)
        if out := close():
            yield out

    return run


def _first(found: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _cell(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def mine(vectors: DataFrame, anchor: Column, top: int = 5, low: int = 80, high: int = 100, unit: int = 100, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for vectors(id, vector, label).

    A component x becomes floor(scale * x). Rows with a null label or vector or a null or non-finite component take no part.
    anchor, a condition on id, marks the anchors; each one's positives are its `top` best other rows of its label, and for
    each positive come the `top` best rows of other labels with low * positive <= unit * score <= high * positive. Ties go
    to the smaller id, null ids last. A null id is no anchor. Each row counts by itself, so a repeated id is a row of its own as
    anchor and as partner. Shorter vectors are filled up with 0; an empty vector scores 0. Without anchors, rows or
    positives the result is empty. Scores that could reach 2^51 are refused with a ValueError.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = vectors.selectExpr("cast(id as long) id", "cast(vector as array<double>) vector", "cast(label as long) label").where("label IS NOT NULL AND vector IS NOT NULL").where(~bad)
    v = F.transform("vector", lambda x: F.floor(x * scale))
    rows = whole.select(F.monotonically_increasing_id().alias("uid"), "id", "label", v.alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = materialize(rows)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, n_anchors, size, norm = rows.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("v")), F.max(square)).first()
    if norm and norm >= MOST:
        raise ValueError(f"scores could reach {norm:.3g}; they have to stay below 2^51")
    primes, size = primes_for(norm or 0), max(1, size or 0)
    groups, slices = max(1, -(-n_anchors // GROUP)), max(1, -(-n // SLICE))
    filled = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), F.lit(size) - F.size("v"))))
    # a hash of the row's number: neither labels nor ids decide, so no group or slice is hot
    rows = rows.select("uid", "id", "label", filled.alias("v"), "anchor", F.pmod(F.xxhash64("uid"), F.lit(groups)).alias("g"), F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(slices)).alias("s"))
    cols = ["uid", "id", "label", "v"]

    def cells(anchors: DataFrame, by_label: bool) -> DataFrame:
        key = ["label", "g", "s"] if by_label else ["g", "s"]
        left = anchors.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select(*cols, F.lit(0).alias("kind"), "wanted", *(F.col(k).alias(f"_{k}") for k in key))
        right = rows.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(*cols, F.lit(1).alias("kind"), F.array().cast("array<long>").alias("wanted"), *(F.col(k).alias(f"_{k}") for k in key))
        dealt = left.unionByName(right).withColumn("cell", _cell(*(F.col(f"_{k}") for k in key))).drop(*(f"_{k}" for k in key))
        dealt = dealt.repartition(parts, "cell").sortWithinPartitions("cell", "kind")
        return dealt.mapInArrow(_cells(primes, top, low, high, unit, by_label), "uid long, place int, id long, score long")

    anchors = rows.where("anchor")
    none = F.array().cast("array<long>").alias("wanted")
    positives = materialize(_first(cells(anchors.select(*cols, "g", none), True), ["uid"], top).select("uid", (F.col("rank") - 1).cast("int").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    wanted = positives.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("x")).select("uid", F.col("x.positive_score").alias("wanted"))
    found = cells(anchors.join(wanted, "uid").select(*cols, "g", "wanted"), False)
    negatives = _first(found, ["uid", "place"], top).select("uid", "place", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = negatives.join(positives, ["uid", "place"]).join(anchors.select("uid", F.col("id").alias("anchor_id")), "uid")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), label.alias("label"))
    return mine(rows, F.col("id") % 100 == 0)


QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLES = {
    "op12_hard_negatives": """
WITH v AS (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.uid AS anchor, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.uid <> b.uid),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS k FROM s WHERE same QUALIFY k <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor, p.k ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
""",
}
