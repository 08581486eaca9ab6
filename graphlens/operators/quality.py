"""Connectivity quality of nodes, gaps, and counts by bin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import EXPECTED_EDGES, QUALITY_WEIGHTS, SYMBOL_KINDS, THIN_CLASS


def scores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, kind, repo, quality and its parts for nodes(id, repo, kind, name, start_line, end_line, raw_code, summary, docstring, has_embedding)."""
    # one pass over both ends of each edge; of the outgoing kinds only the expected ones matter
    wanted = sorted({"contains", *(k for want in EXPECTED_EDGES.values() for k in want)})
    end = lambda column, out: F.struct(F.col(column).alias("id"), "kind", F.lit(out).alias("out"))
    e = edges.select(F.explode(F.array(end("source", True), end("target", False))).alias("e")).select("e.*")
    link, out = F.col("kind") != "contains", F.col("out")
    sums = e.groupBy("id").agg(F.count_if(link).alias("m"), F.count_if(out & ~link).alias("c"), *(F.max(out & (F.col("kind") == k)).alias(f"has_{k}") for k in wanted))
    n = nodes.join(sums, "id", "left")
    m = F.coalesce("m", F.lit(0))
    c = F.coalesce("c", F.lit(0))
    low = F.lower("name")
    named = F.lit(False)
    for p in THIN_CLASS:
        named = named | F.contains(low, F.lit(p))
    has = lambda col: F.coalesce(F.length(col), F.lit(0)) > 0
    short = F.coalesce((F.col("start_line") != 0) & (F.col("end_line") != 0) & (F.col("end_line") - F.col("start_line") < 15), F.lit(False)) | (has("raw_code") & (F.length("raw_code") < 300))
    is_class, is_file, is_symbol = F.col("kind") == "class", F.col("kind") == "file", F.col("kind").isin(*SYMBOL_KINDS)
    thin = is_class & (named | short)
    sat = lambda x, k: 1 - 1 / (1 + x / F.lit(float(k)))
    density = F.when(thin, F.least(F.lit(1.0), 0.6 + 0.1 * m)).when(is_class, sat(m + c, 4)).when(is_symbol, sat(m, 5)).when(is_file, sat(c, 3)).otherwise(sat(m, 3))
    embedded = F.col("has_embedding").cast("double")
    content = (has("raw_code") | has("summary")).cast("double")
    content = F.when(is_symbol, 0.7 * content + 0.3 * has("docstring").cast("double")).otherwise(content)
    kinds = F.array_compact(F.array(*(F.when(F.col(f"has_{k}"), F.lit(k)) for k in wanted)))
    expected = F.when(is_file & (c == 0), F.array().cast("array<string>")).when(is_file & (c <= 2), F.array(F.lit("contains")))
    for kind, want in EXPECTED_EDGES.items():
        expected = expected.when(F.col("kind") == kind, F.array(*map(F.lit, want)))
    expected = expected.otherwise(F.array().cast("array<string>"))
    missing = F.array_except(expected, kinds)
    coverage = F.when(F.size(expected) == 0, 1.0).otherwise(F.size(F.array_intersect(expected, kinds)) / F.size(expected))
    weights = {k: F.array(*map(F.lit, w)) for k, w in QUALITY_WEIGHTS.items()}
    w = F.when(thin, weights["thin"]).when(is_symbol, weights["symbol"]).when(is_file, weights["file"]).otherwise(weights["other"])
    parts = n.select("id", "kind", "repo", thin.alias("thin"), m.alias("links"), density.alias("density"), embedded.alias("embedded"), content.alias("content"), coverage.alias("coverage"), F.array_sort(missing).alias("missing"), w.alias("w"))
    quality = F.col("w")[0] * F.col("density") + F.col("w")[1] * F.col("embedded") + F.col("w")[2] * F.col("content") + F.col("w")[3] * F.col("coverage")
    return parts.withColumn("quality", quality).drop("w")


def overview(scored: DataFrame, threshold: float = 0.4) -> DataFrame:
    """One row of totals, mean and bins; repositories are left out."""
    q = F.col("quality")
    return scored.where("kind != 'repository'").agg(
        F.count("*").alias("total"), F.avg(q).alias("mean"), F.count_if(q >= 0.7).alias("high"), F.count_if((q >= 0.4) & (q < 0.7)).alias("medium"), F.count_if(q < 0.4).alias("low"), F.count_if(q < threshold).alias("gaps"),
    )


def gaps(scored: DataFrame, threshold: float = 0.4, top: int = 50) -> DataFrame:
    """The worst nodes below the threshold with their reasons."""
    symbol = F.col("kind").isin(*SYMBOL_KINDS)
    reasons = F.filter(F.array(
        F.when(F.size("missing") > 0, F.concat(F.lit("missing edges: "), F.array_join("missing", ", "))),
        F.when(F.col("embedded") == 0, F.lit("no embedding")), F.when(F.col("content") < 0.5, F.lit("no code or summary")),
        F.when(symbol & (F.col("links") == 0) & ~F.col("thin"), F.lit("isolated")),
    ), lambda x: x.isNotNull())
    found = scored.where((F.col("kind") != "repository") & (F.col("quality") < threshold)).orderBy("quality", "id").limit(top)
    text = F.array_join(reasons, "; ")
    return found.select("id", "kind", "quality", F.when(text == "", F.lit("low overall connectivity")).otherwise(text).alias("reasons"))
