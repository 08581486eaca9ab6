"""Corpus pipeline: rules, classifier, exact copies, near copies, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return rows of docs
with all their columns; the last returns packed pieces.

In every stage null and empty texts are texts without words; texts of any length are read whole; other columns pass through
untouched, also where their names clash with those of an operator; an empty table gives an empty result. What a stage does
with null ids, ties and repeated rows is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm import exact_dedup, ngram_join, packing, pu_quality, quality_rules
from graphlens.llm.bpe import byte_bpe_path
from graphlens.llm.common import materialize, narrow_side, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither a base rule nor a learned rule rejects; each row is judged by its own text, whatever its id.

    Without labels nothing is learned, and only the base rules reject.
    """
    return quality_rules.keep_good(docs, quality_rules.learn_rules(quality_rules.labelled_sample(docs, table(spark, sf_dir, "labels"))))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier scores at 0.7 or more; each row is judged by its own text, whatever its id.

    Without labelled documents there is no classifier, and all stay.
    """
    return pu_quality.keep_good(docs, pu_quality.train(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, one with the smallest id.

    A row goes by its id and text, so other texts of its id stay. Null ids lose against any id; of a group with null ids only,
    and of rows with the same id and equal text, one stays.
    """
    sha = F.sha2(exact_dedup.normalised("text").cast("binary"), 256)
    found = materialize(exact_dedup.exact_duplicates(docs).where("group_size > 1").groupBy("doc_id", "text_sha256").agg(F.first("kept").alias("kept"), F.count("*").alias("n")).where("NOT kept OR n > 1"))
    side = found.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), F.col("kept").alias("__kept"))
    both = docs.withColumn("__own", sha).join(narrow_side(side), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__sha")), "left")
    again = both.where("__kept").dropDuplicates(["__id", "__sha"])
    return both.where("__kept IS NULL").unionByName(again).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id. Rows of one id are one document: they stay or go together.

    Rows with a null id, and texts without words, are in no group and stay.
    """
    return ngram_join.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, packed into sequences. Repeated rows and null ids are packed like any other."""
    return packing.pack(packing.pieces(docs, byte_bpe_path()))


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("exact_dedup", exact), ("ngram_join", near), ("packing", packed)]

#: The learned stages have no SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
