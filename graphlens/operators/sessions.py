"""Session context: decay, deduplication, caps and the topic vector."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import cosine
from ..sources.shared import numbered


def weight(turns_ago: Column, topic: Column | None = None, half_life: float = 5.0) -> Column:
    """Half-life decay by turns, plus a fifth of a positive topic similarity, at most 1."""
    w = F.exp(-F.lit(math.log(2) / half_life) * turns_ago)
    return F.least(F.lit(1.0), w + 0.2 * F.greatest(F.lit(0.0), topic) if topic is not None else w)


def action(w: Column) -> Column:
    """What a node that was already sent gets: dropped above 0.8, its summary above 0.3, else all of it."""
    return F.when(w > 0.8, "drop").when(w > 0.3, "summary").otherwise("full")


def prune(context: DataFrame, keep: int = 500) -> DataFrame:
    """The latest `keep` entries of each session(session_id, turn, node_id)."""
    rn = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn"), "node_id"))
    return context.withColumn("rn", rn).where(F.col("rn") <= keep).drop("rn")


def dedup(bundle: DataFrame, context: DataFrame, current_turn: int, half_life: float = 5.0, question: Column | None = None) -> DataFrame:
    """bundle(node_id, ...) with the action that the session's context(turn, node_id) asks for; nodes not seen are full.

    With a question's vector, and the vector vec of the question that each node came with in context, nodes of a similar topic
    fade more slowly. A node's last turn counts; a null vector gives no bonus.
    """
    last = F.max_by(F.struct("turn", *(["vec"] if question is not None else [])), F.col("turn")).alias("seen")
    seen = context.groupBy("node_id").agg(last)
    near = F.when(F.col("seen.vec").isNotNull() & question.isNotNull(), cosine(F.col("seen.vec"), question)).otherwise(F.lit(0.0)) if question is not None else None
    w = weight(F.lit(current_turn) - F.col("seen.turn"), near, max(half_life, 1))
    return bundle.join(seen, "node_id", "left").withColumn("action", F.when(F.col("seen").isNull(), "full").otherwise(action(w))).drop("seen")


def topic(queries: DataFrame, alpha: float = 0.3) -> DataFrame:
    """queries(session_id, turn, vec) -> session_id, topic: the moving average alpha * query + (1 - alpha) * topic over the turns.

    A turn weighs alpha * (1 - alpha)^(later turns), the first one without alpha; sums are taken per dimension.
    """
    rows = numbered(queries.select("session_id", "turn", "vec"), F.col("session_id"), F.col("turn"), F.col("vec"))
    ends = rows.groupBy(F.col("session_id").alias("s")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("vec").isNull()).alias("gap"))
    rows = rows.join(ends, F.col("session_id").eqNullSafe(F.col("s")))
    w = F.when(F.col("n") == F.col("lo"), 1.0).otherwise(alpha) * F.pow(F.lit(1.0 - alpha), F.col("hi") - F.col("n"))
    parts = rows.select("s", "lo", "hi", w.alias("w"), F.posexplode("vec").alias("dim", "x")).groupBy("s", "lo", "hi", "dim")
    sums = parts.agg(F.sum(F.col("w") * F.col("x").cast("double")).alias("x"), F.count("x").alias("k"))
    # a dimension that a turn lacks is null
    sums = sums.withColumn("x", F.when(F.col("k") == F.col("hi") - F.col("lo") + 1, F.col("x")))
    sums = sums.groupBy("lo").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda c: c["x"]).alias("topic"))
    # sessions are told apart by their first number, as ids may be null
    topic = F.when(~F.col("gap"), F.coalesce("topic", F.array().cast("array<double>")))
    return ends.join(sums, "lo", "left").select(F.col("s").alias("session_id"), topic.alias("topic"))


def record(context: DataFrame, queries: DataFrame) -> DataFrame:
    """queries(session_id, seq, node_id) numbered as turns after the last one of the session's context(session_id, turn, node_id)."""
    last = context.groupBy("session_id").agg(F.max("turn").alias("last"))
    turn = F.dense_rank().over(Window.partitionBy("session_id").orderBy("seq"))
    new = queries.withColumn("turn", turn).join(last, "session_id", "left").withColumn("turn", (F.coalesce("last", F.lit(0)) + F.col("turn")).cast("int"))
    return context.select("session_id", "turn", "node_id").unionByName(new.select("session_id", F.col("turn").cast(context.schema["turn"].dataType), "node_id"))


def state(context: DataFrame) -> DataFrame:
    """session_id, turns, nodes: how far each session is."""
    return context.groupBy("session_id").agg(F.max("turn").alias("turns"), F.count_distinct("node_id").alias("nodes"))


def unexpired(sessions: DataFrame, now: Column, days: int = 7) -> DataFrame:
    return sessions.where(F.col("updated_at") >= now - F.make_interval(days=F.lit(days))).orderBy(F.desc("updated_at"))
