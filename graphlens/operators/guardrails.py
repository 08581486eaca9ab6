"""Rules over a change: bans, cycles, thresholds, scopes; approvals, verdicts and file access policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import any_glob, glob_match
from ..schemas import CROSS_REPO_KINDS
from . import graph


def dependency_ban(nodes: DataFrame, new_edges: DataFrame, source_pattern: str, target_pattern: str, kinds=None, cross_repo_only: bool = False) -> DataFrame:
    """New edges whose ends' paths match both globs. An end that is no node stands for its own path; a node without path never matches."""
    e = new_edges.where(F.col("kind").isin(*kinds)) if kinds else new_edges
    e = e.where(F.col("kind").isin(*CROSS_REPO_KINDS)) if cross_repo_only else e
    for end in ("source", "target"):
        n = nodes.select(F.col("id").alias(end), F.col("path").alias(f"{end}_own"), F.lit(True).alias(f"{end}_known"))
        e = e.join(n, end, "left").withColumn(f"{end}_path", F.when(F.col(f"{end}_known"), F.col(f"{end}_own")).otherwise(F.col(end))).drop(f"{end}_own", f"{end}_known")
    return e.where(glob_match(F.col("source_path"), source_pattern) & glob_match(F.col("target_path"), target_pattern)).select("source", "target", "kind", "source_path", "target_path")


def metric_threshold(nodes: DataFrame, edges: DataFrame, changed: DataFrame, metric: str, threshold: float, target_pattern: str | None = None) -> DataFrame:
    """Changed nodes whose coupling metric is over the threshold: id, value."""
    column = {"afferent_coupling": "ca", "efferent_coupling": "ce", "instability": "instability"}[metric]
    n = nodes.join(changed.select("id").distinct(), "id", "left_semi")
    n = n.where(F.col("path").isNull() | glob_match(F.col("path"), target_pattern)) if target_pattern else n
    return graph.coupling(n, edges.join(n.select(F.explode(F.array("id")).alias("source")), "source", "left_semi").unionByName(edges.join(n.select(F.col("id").alias("target")), "target", "left_semi")).distinct()).where(F.col(column) > threshold).select("id", F.col(column).cast("double").alias("value"))


def impact_threshold(nodes: DataFrame, edges: DataFrame, changed: DataFrame, max_impact: int, max_hops: int = 3, kinds=None) -> DataFrame:
    """Changed nodes with more than max_impact dependants within max_hops: id, total.

    All changed nodes are walked together; a row of the frontier is (changed node, node reached).
    """
    start = nodes.join(changed.select("id").distinct(), "id", "left_semi")
    start = start.where(F.col("kind").isin(*kinds)) if kinds else start
    counts = graph.impact_counts(graph.impact_roles(nodes, edges, start, max_hops))
    return counts.where(F.col("total") > max_impact).select(F.col("target").alias("id"), "total")


def file_scope_ban(files: DataFrame, pattern: str) -> DataFrame:
    return files.where(glob_match(F.col("path"), pattern)).select("path").distinct()


def verdict(violations: DataFrame) -> DataFrame:
    """One row: counts by severity and whether no block is left that isn't approved."""
    block = F.col("severity") == "block"
    pending = block & (F.coalesce("approval_status", F.lit("pending")) != "approved")
    return violations.agg(
        F.count("*").alias("total"), F.count_if(F.col("severity") == "info").alias("info"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(block).alias("blocks"), F.count_if(pending).alias("pending"), (F.count_if(pending) == 0).alias("passed"),
    )


def approve(violations: DataFrame, approved: Column) -> DataFrame:
    """Blocks get an approval status by an array of approved rule ids; others have none."""
    status = F.when(F.col("severity") == "block", F.when(F.array_contains(approved, F.col("rule_id")), "approved").otherwise("pending"))
    return violations.withColumn("approval_status", status)


def may_access(path: Column, allow, deny) -> Column:
    """Deny first; then anything if nothing is allowed by name, else only what is."""
    allowed = any_glob(path, allow) if allow else F.lit(True)
    return F.when(any_glob(path, deny), False).otherwise(allowed)


def approvals(messages: DataFrame, key: str = "Approved-Rules", reason_key: str = "Approved-Reason") -> DataFrame:
    """messages(id, message) -> id, rule_ids (sorted), reason (the last that isn't empty)."""
    line = F.explode(F.transform(F.split("message", "\\r?\\n"), lambda x, i: F.struct(F.trim(x).alias("s"), i.alias("i"))))
    lines = messages.select("id", line.alias("x")).select("id", "x.i", "x.s")
    low, value = F.lower("s"), F.substring_index("s", ":", -1)
    value = F.substring(F.col("s"), F.instr("s", ":") + 1, F.length("s"))
    is_reason = low.startswith(reason_key.lower() + ":")
    is_rules = low.startswith(key.lower() + ":")
    ids = F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")
    found = lines.select("id", "i", F.when(is_rules, ids).alias("ids"), F.when(is_reason, F.nullif(F.trim(value), F.lit(""))).alias("reason"))
    out = found.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("rule_ids"), F.max_by("reason", F.when(F.col("reason").isNotNull(), F.col("i"))).alias("reason"))
    return out.select("id", "rule_ids", F.coalesce("reason", F.lit("")).alias("reason"))


def lines_overlap(nodes: DataFrame, hunks: DataFrame, bin_size: int = 50) -> DataFrame:
    """nodes(id, path, start_line, end_line) that touch hunks(path, hunk_start, hunk_end), ends included.

    Both sides are spread over bins of lines, so the join is an equi-join on path and bin with the overlap as a filter.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_size), F.floor(F.col(b) / bin_size)))
    n = nodes.where("start_line <= end_line").select("id", "path", "start_line", "end_line", bins("start_line", "end_line").alias("bin"))
    h = hunks.where("hunk_start <= hunk_end").select("path", "hunk_start", "hunk_end", bins("hunk_start", "hunk_end").alias("bin"))
    return n.join(h, ["path", "bin"]).where("start_line <= hunk_end AND end_line >= hunk_start").select("id").distinct()
