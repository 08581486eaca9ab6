"""Embeddings without a service: TF-IDF of words and name parts under a seeded sparse random projection.

The model is a table of document frequencies, so all vectors of a store come from the same one, whenever they are made. Each
term has a few signed places that its seeded hash gives, so no matrix is held anywhere: a text's vector is a sum over its terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import materialize
from .text import tokens

MODEL = "term string, df long, n long"
SIZE, PLACES = 128, 4


def fit(texts: DataFrame) -> DataFrame:
    """The model of texts(id, text): document frequencies, and the number of texts."""
    n = texts.count()
    words = texts.select(F.explode(F.array_distinct(tokens(F.coalesce("text", F.lit("")).alias("text")))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("df")).withColumn("n", F.lit(n).cast("long"))


def _vectors(weights: DataFrame, size: int, seed: int) -> DataFrame:
    """id, embedding of weights(id, term, w): unit length."""
    h = F.xxhash64("term", F.lit(seed), F.col("place"))
    spread = weights.withColumn("place", F.explode(F.array(*map(F.lit, range(PLACES))))).withColumn("h", h)
    slot, sign = F.pmod("h", F.lit(size)).cast("int"), F.when(F.shiftright("h", 62).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0)
    sums = spread.groupBy("id", slot.alias("slot")).agg(F.sum(F.col("w") * sign).alias("x"))
    whole = sums.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.when(F.col("norm") > 0, F.coalesce(F.element_at("m", k), F.lit(0.0)) / F.col("norm")).otherwise(0.0).cast("float"))
    return whole.select("id", cells.alias("embedding"))


def embed(texts: DataFrame, model: DataFrame, size: int = SIZE, seed: int = 1, known: bool = False) -> DataFrame:
    """id, embedding for texts(id, text). A term weighs (1 + ln count) * ln((1 + n) / (1 + df)); one that the model lacks has df 0, or is
    left out with `known`.

    A text without words is the zero vector. Rows with one id are one text.
    """
    counts = texts.select("id", F.explode(tokens(F.coalesce("text", F.lit("")))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("k"))
    n = model.agg(F.max("n")).first()[0] or 0
    idf = F.log((1.0 + n) / (1.0 + F.coalesce("df", F.lit(0))))
    weights = counts.join(model.select("term", "df"), "term", "inner" if known else "left").select("id", "term", ((1 + F.log(F.col("k"))) * idf).alias("w"))
    found = _vectors(weights, size, seed)
    zero = F.array_repeat(F.lit(0.0).cast("float"), size)
    return texts.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("embedding", zero).alias("embedding"))


def question(spark: SparkSession, text: str, model: DataFrame, size: int = SIZE, seed: int = 1) -> Column:
    """The vector of a question, as a column for vector.top_k. Terms that the model lacks say nothing of any text and are left out."""
    asked = spark.createDataFrame([(0, text)], "id int, text string")
    terms = [r[0] for r in asked.select(F.explode(tokens(F.col("text")))).distinct().collect()]
    n = model.agg(F.max("n")).first()[0] or 0
    own = materialize(model.where(F.col("term").isin(terms)).unionByName(spark.createDataFrame([("", 0, n)], MODEL)))
    return F.array(*(F.lit(float(x)) for x in embed(asked, own, size, seed, known=True).first()["embedding"]))
