"""BM25 over a kept index: a question reads the postings of its terms, not the documents.

Postings (by term) and the terms of each document (by document) are kept by deltas. What the scores need of the whole corpus is
additive: the number of documents and of terms, and how many terms have each document frequency, from which the mean idf follows.
A document's change moves these counters by the difference, for which its old terms and their frequencies are looked up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import split_name
from ..schemas import TEXT_WORD
from ..sources.kept import Kept
from ..sources.shared import materialize
from ..sources.snapshots import Append, Replace, Store, View
from .text import tokens

POSTINGS = Kept("bm25_postings", "id string, term string, tf long, dl long", ("id",), "term", 64)
FORWARD = Kept("bm25_forward", "id string, term string, tf long", ("id",), "id", 64)
#: Sums of d are the document frequencies.
FREQUENCIES = Kept("bm25_frequencies", "term string, d long", ("term",), "term", 64)
_COUNTS, _SPREAD = "bm25_counts", "bm25_spread"
_COUNTS_ROWS, _SPREAD_ROWS = "documents long, terms long", "df long, n long"


def _terms(docs: DataFrame) -> DataFrame:
    """id, term, tf, dl of docs(id, text); words are counted before their names are split. A document's rows meet once, by its id."""
    found = docs.repartition("id").select("id", F.explode(F.regexp_extract_all("text", F.lit(TEXT_WORD), F.lit(0))).alias("w")).groupBy("id", "w").agg(F.count("*").alias("k"))
    whole = F.col("w").rlike("^[A-Z]?[a-z]+$")  # a name of one word, which is its own only part
    part = lambda term, times: F.struct(term.alias("term"), F.lit(times).alias("times"))
    parts = F.when(whole, F.array(part(F.lower("w"), 2))).otherwise(F.transform(F.concat(F.array(F.lower("w")), split_name(F.col("w"))), lambda t: part(t, 1)))
    terms = found.select("id", "k", F.explode(parts).alias("p")).groupBy("id", "p.term").agg(F.sum(F.col("k") * F.col("p.times")).alias("tf"))
    return terms.withColumn("dl", F.sum("tf").over(Window.partitionBy("id")))


def changed(view: View, docs: DataFrame, gone: DataFrame) -> dict:
    """What a commit writes so that the index has docs(id, text) in place of theirs and of gone(id).

    Rows with one id are one document; a document without words is not in the index; null ids are left out.
    """
    docs = docs.select(F.col("id").cast("string").alias("id"), "text").where("id IS NOT NULL")
    new = materialize(_terms(docs))
    out_ids = materialize(docs.select("id").unionByName(gone.select(F.col("id").cast("string").alias("id")).where("id IS NOT NULL")).distinct())
    old = materialize(FORWARD.read(view, out_ids))
    moves = new.select("term", F.lit(1).alias("d")).unionByName(old.select("term", F.lit(-1).alias("d"))).groupBy("term").agg(F.sum("d").alias("d")).where("d != 0")
    moves = materialize(moves)
    before = FREQUENCIES.read(view, moves.select("term")).groupBy("term").agg(F.sum("d").alias("df"))
    steps = moves.join(before, "term", "left").select(F.coalesce("df", F.lit(0)).alias("old"), (F.coalesce("df", F.lit(0)) + F.col("d")).alias("new"))
    spread = steps.select("old", F.lit(-1).alias("n")).unionByName(steps.select(F.col("new").alias("old"), F.lit(1).alias("n"))).where("old > 0").groupBy(F.col("old").cast("long").alias("df")).agg(F.sum("n").alias("n")).where("n != 0")
    count = lambda df, sign: df.agg((sign * F.count_distinct("id")).alias("documents"), (sign * F.coalesce(F.sum("tf"), F.lit(0))).alias("terms"))
    counts = count(new, 1).unionByName(count(old, -1)).agg(F.sum("documents").alias("documents"), F.sum("terms").alias("terms"))
    none = view.store.spark.createDataFrame([], "term string")
    return {
        **POSTINGS.delta(view, new, out_ids), **FORWARD.delta(view, new, out_ids), **FREQUENCIES.delta(view, moves, none),
        _COUNTS: Append(counts.coalesce(1)), _SPREAD: Append(spread.coalesce(1)),
    }


def update(store: Store, docs: DataFrame, gone: DataFrame | None = None) -> None:
    """One commit of changed(); gone: ids of documents to remove."""
    store.commit(lambda view: changed(view, docs, docs.select("id").limit(0) if gone is None else gone))


def compact(store: Store) -> None:
    """Merges all deltas and drops what no longer counts."""

    def change(view: View) -> dict:
        sums = FREQUENCIES.read(view).groupBy("term").agg(F.sum("d").alias("d")).where("d != 0")
        frequencies = FREQUENCIES.delta(view, sums, view.store.spark.createDataFrame([], "term string"))[FREQUENCIES.name]
        counts = view.load(_COUNTS, _COUNTS_ROWS).agg(F.sum("documents").alias("documents"), F.sum("terms").alias("terms"))
        spread = view.load(_SPREAD, _SPREAD_ROWS).groupBy("df").agg(F.sum("n").alias("n")).where("n != 0")
        return {**POSTINGS.compact(view), **FORWARD.compact(view), FREQUENCIES.name: Replace(frequencies.rows, frequencies.by), _COUNTS: counts, _SPREAD: spread}

    store.commit(change)


def search(view: View, query: str, k: int = 9, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """id, score of the k best, as operators.text.bm25 gives them for the documents of the index."""
    spark = view.store.spark
    asked = [(r[0], r[1]) for r in spark.range(1).select(F.explode(tokens(F.lit(query))).alias("term")).groupBy("term").agg(F.count("*")).collect()]
    counts = view.load(_COUNTS, _COUNTS_ROWS).agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    n, total = counts
    idf = lambda df: F.log(F.lit(n) - df + 0.5) - F.log(df + 0.5)
    spread = view.load(_SPREAD, _SPREAD_ROWS).groupBy("df").agg(F.sum("n").alias("n"))
    mean = spread.agg(F.sum(idf(F.col("df")) * F.col("n")) / F.sum("n")).first()[0] or 0.0
    words = spark.createDataFrame(asked, "term string, qn long")
    postings = POSTINGS.read(view, [t for t, _ in asked])
    postings = materialize(postings)
    weights = postings.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(words), "term")
    weights = weights.select("term", "qn", F.when(idf(F.col("df")) < 0, epsilon * mean).otherwise(idf(F.col("df"))).alias("idf"))
    avg = total / n if n else 1.0
    part = F.col("qn") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avg))
    best = postings.join(F.broadcast(weights), "term").groupBy("id").agg(F.sum(part).alias("raw")).orderBy(F.desc("raw"), "id").limit(k)
    top = F.max("raw").over(Window.partitionBy(F.lit(0)))  # k rows
    return best.withColumn("score", F.when(top > 0, F.col("raw") / top)).where("raw > 0").select("id", "score")
