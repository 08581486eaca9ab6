"""Vector search: exact cosine top-k, filtered, by level, and a hashing embedder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import cosine


def literal(vector) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def scored(vectors: DataFrame, query: Column, where: dict | None = None, unit: bool = False) -> DataFrame:
    """id and score of each vector that fits the equalities; `unit` maps the cosine to (1 + cos) / 2."""
    rows = vectors
    for k, v in (where or {}).items():
        rows = rows.where(F.col(k) == v)
    score = cosine(F.col("embedding"), query)
    return rows.withColumn("score", (1 + score) / 2 if unit else score)


def top_k(vectors: DataFrame, query: Column, k: int = 10, where: dict | None = None, unit: bool = False) -> DataFrame:
    """The k nearest; ties go to the smaller id. A task keeps k rows of its own, so only those are exchanged."""
    return scored(vectors, query, where, unit).orderBy(F.desc("score"), "id").limit(k)


def beam(vectors: DataFrame, query: Column, symbol_kinds, width: int = 3, levels=("repository", "module", "file")) -> DataFrame:
    """Top `width` of each container kind and the symbols among the top 3 * width of all; the best 3 * width of these."""
    rows = scored(vectors, query).select("id", "kind", "score")
    per = Window.partitionBy("kind").orderBy(F.desc("score"), "id")
    by_kind = rows.where(F.col("kind").isin(*levels)).withColumn("rn", F.row_number().over(per)).where(F.col("rn") <= width).drop("rn")
    overall = rows.orderBy(F.desc("score"), "id").limit(3 * width).where(F.col("kind").isin(*symbol_kinds))
    return by_kind.unionByName(overall).dropDuplicates(["id"]).orderBy(F.desc("score"), "id").limit(3 * width)


def hashing_embedding(text: Column, size: int = 64) -> Column:
    """Feature hashing of a text's words (ASCII letters and digits): signed counts, not normalised."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    slots = F.sequence(F.lit(0), F.lit(size - 1))
    sign = lambda h: F.when(F.shiftright(h, 63) == 0, 1.0).otherwise(-1.0)
    return F.transform(slots, lambda s: F.aggregate(F.filter(hashed, lambda h: F.pmod(h, F.lit(size)) == s), F.lit(0.0), lambda a, h: a + sign(h)).cast("float"))
