"""Recency, hotspots and co-retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import recency, saturate


def hotspots(nodes: DataFrame, now: Column, k: int = 20) -> DataFrame:
    """nodes(id, modification_count, last_modified): the k largest 0.6 * change frequency + 0.4 * recency."""
    score = 0.6 * saturate(F.col("modification_count"), 10) + 0.4 * recency(F.col("last_modified"), now)
    return nodes.where("modification_count > 0").withColumn("score", score).orderBy(F.desc("score"), "id").limit(k)


def rerank(scored: DataFrame, now: Column, with_quality: bool = True) -> DataFrame:
    """scored(id, score, last_modified, modification_count, co_retrieved, quality): the temporal blend. Opt-in: search leaves it out by default."""
    parts = (F.coalesce("score", F.lit(0.5)), recency(F.col("last_modified"), now), saturate(F.col("modification_count"), 10), saturate(F.col("co_retrieved"), 10))
    weights = (0.45, 0.18, 0.12, 0.12) if with_quality else (0.5, 0.2, 0.15, 0.15)
    total = sum((w * p for w, p in zip(weights, parts, strict=True)), F.lit(0.0))
    return scored.withColumn("final", total + 0.13 * F.col("quality") if with_quality else total)


def co_retrieval(retrieved: DataFrame) -> DataFrame:
    """retrieved(retrieval_id, id) -> id, other_id, cnt: how often two nodes were in one result. Results are small by their budget."""
    a, b = retrieved.select("retrieval_id", "id"), retrieved.select("retrieval_id", F.col("id").alias("other_id"))
    return a.join(b, "retrieval_id").where("id != other_id").groupBy("id", "other_id").agg(F.count("*").alias("cnt"))


def file_history(commits: DataFrame, cap: int = 50) -> DataFrame:
    return commits.groupBy("repo", "path").agg(F.max("committed_at").alias("last_modified"), F.least(F.count("*"), F.lit(cap)).alias("modification_count"))
