"""What a diff changes in a graph, and the verdict of rules on it."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import any_glob, symbol_kind
from ..schemas import EDGE_KINDS
from ..sources import parse
from ..sources.shared import materialize
from . import graph, guardrails

log = logging.getLogger(__name__)
VIOLATION = "rule_id string, description string, severity string, message string, file_path string, evidence array<string>, suggested_fix string"


@dataclass(frozen=True)
class ChangeSet:
    """files(path, status), modified(id), new_nodes, new_edges and removed_edges(source, target, kind) of a change."""

    files: DataFrame
    modified: DataFrame
    new_nodes: DataFrame
    new_edges: DataFrame
    removed_edges: DataFrame


def _ends(path: Column) -> Column:
    """What follows each slash of a path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts) - k + 1), "/"))


def suffix_pairs(paths: DataFrame, files: DataFrame) -> DataFrame:
    """path, file of paths(path) and files(file) that are equal or end with the other behind a slash.

    Joins on equal paths and on what follows a slash, so that only pairs that match are made, however often a base name occurs.
    """
    p, f = paths.select("path").where("path != ''").distinct(), files.select("file").where("file != ''").distinct()
    deep = lambda df, c: df.where(F.contains(F.col(c), F.lit("/"))).select(c, F.explode(_ends(F.col(c))).alias("end"))
    equal = p.join(f, p["path"] == f["file"]).select("path", "file")
    longer = deep(p, "path").join(f, F.col("end") == F.col("file")).select("path", "file")
    shorter = deep(f, "file").join(p, F.col("end") == F.col("path")).select("path", "file")
    return equal.unionByName(longer).unionByName(shorter)


def in_files(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """nodes and files(path) whose paths are equal or one the other's end: file, and the node's columns."""
    n = nodes.where("path != ''")
    return n.join(suffix_pairs(n, files.select(F.col("path").alias("file"))), "path").select(*n.columns, "file")


def infer_repositories(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """files(path) -> path, repo: the only repository; else that of the first node whose path begins with a part that the file's
    path starts with; else the first repository by name; `unknown` without nodes."""
    repos = nodes.agg(F.min("repo").alias("least"), F.max("repo").alias("most"))
    part = F.substring_index("path", "/", 1)
    parts = nodes.where("path != ''").groupBy(part.alias("part")).agg(F.min_by(F.struct("repo"), F.struct("seq", "id")).alias("n"), F.min(F.struct("seq", "id")).alias("at"))
    own = files.select("path").distinct()
    heads = own.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(part), F.lit(1))), lambda k: F.substring(part, F.lit(1), k))).alias("part"))
    found = heads.join(parts, "part").groupBy("path").agg(F.min_by("n.repo", "at").alias("found"))
    out = own.join(found, "path", "left").crossJoin(F.broadcast(repos))  # one row
    return out.select("path", F.coalesce(F.when(F.col("least") == F.col("most"), F.col("least")), "found", "least", F.lit("unknown")).alias("repo"))


def analyze(diffs: DataFrame, nodes: DataFrame, edges: DataFrame) -> ChangeSet:
    """The change of diffs(id, diff) against a graph.

    All nodes of a deleted file are modified, of a modified one those whose lines a hunk touches. The symbols of added files
    are new nodes. Imports in added and removed lines of a modified file are edges from its file node.
    """
    hunks = materialize(parse.diff_hunks(diffs))
    deleted = F.col("status") == "deleted"
    files = hunks.select(F.when(deleted, F.col("old_path")).otherwise(F.col("new_path")).alias("path"), "status").distinct()
    there = materialize(in_files(nodes, files).select("file", "id", "kind", "start_line", "end_line", "seq"))
    gone = there.join(files.where(deleted).select(F.col("path").alias("file")), "file", "left_semi").select("id")
    changed = hunks.where(F.col("status").isin("modified", "renamed"))
    touched = guardrails.lines_overlap(there.withColumnRenamed("file", "path"), changed.where("hunk_start IS NOT NULL").select(F.col("new_path").alias("path"), "hunk_start", "hunk_end"))
    modified = materialize(gone.unionByName(touched).distinct())

    whole = Window.partitionBy("id", "file_seq").orderBy("hunk_start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lines = hunks.where("status = 'added'").withColumn("lines", F.flatten(F.collect_list("added").over(whole))).select(F.col("new_path").alias("path"), F.array_join("lines", "\n").alias("content")).distinct()
    added = lines.join(infer_repositories(nodes, lines), "path").select("repo", "path", "content")
    s = parse.symbols(added)
    new_nodes = s.select(F.concat("repo", F.lit(":"), "path", F.lit("::"), "name").alias("id"), "repo", symbol_kind(F.col("kind"), True).alias("kind"), "name", "path", "start_line", "end_line", F.col("code").alias("raw_code"), "signature", "docstring")

    owner = there.groupBy("file").agg(F.min_by("id", F.struct((F.col("kind") != "file"), "seq", "id")).alias("source"))

    def imports(column: str) -> DataFrame:
        line = changed.select(F.col("new_path").alias("file"), F.explode(column).alias("line")).select("file", parse.import_target(F.trim("line")).alias("target")).where("target IS NOT NULL")
        return line.join(owner, "file").select("source", "target", F.lit("imports").alias("kind")).distinct()

    return ChangeSet(files, modified, materialize(new_nodes), materialize(imports("added")), materialize(imports("removed")))


def _violations(df: DataFrame, rule: dict, message, file_path=None, evidence=(), fix: str = "") -> DataFrame:
    nothing = F.lit(None).cast("string")
    return df.select(
        F.lit(rule["id"]).alias("rule_id"), F.lit(rule["description"]).alias("description"), F.lit(rule["severity"]).alias("severity"), message.alias("message"), (nothing if file_path is None else file_path).alias("file_path"),
        F.array(*evidence).cast("array<string>").alias("evidence"), F.lit(fix).alias("suggested_fix"),
    )


def _known(kinds) -> list[str]:
    return [k for k in ([kinds] if isinstance(kinds, str) else kinds or []) if k in EDGE_KINDS]


def _check(rule: dict, nodes: DataFrame, edges: DataFrame, change: ChangeSet) -> DataFrame:
    c, text = rule["config"], F.format_string
    if rule["type"] == "dependency_ban":
        found = guardrails.dependency_ban(nodes, change.new_edges, c["source_pattern"], c["target_pattern"], _known(c.get("edge_kind")), bool(c.get("cross_repo_only")))
        ends = [F.concat(F.lit("source: "), "source"), F.concat(F.lit("target: "), "target"), F.concat(F.lit("edge_kind: "), "kind")]
        return _violations(found, rule, text("Banned dependency: %s -> %s (%s)", "source_path", "target_path", "kind"), F.col("source_path"), ends, "Remove the dependency or go through an interface.")
    if rule["type"] == "cycle_detection":
        kinds = _known(c.get("edge_kinds")) or (["api_calls", "shared_lib", "proto_defines"] if c["scope"] == "cross_repo" else ["imports"])
        found = graph.new_cycles(edges, change.new_edges, kinds)
        return _violations(found, rule, F.concat(F.lit("Circular dependency: "), F.array_join(F.concat("cycle", F.slice("cycle", 1, 1)), " -> ")), fix="Remove or turn round one dependency of the cycle.")
    if rule["type"] == "metric_threshold":
        found = guardrails.metric_threshold(nodes, edges, change.modified, c["metric"], float(c["threshold"]), c.get("target_pattern")).join(nodes.select("id", "name", "path"), "id")
        return _violations(found, rule, text(f"{c['metric']} of %s is %s, over {c['threshold']}", "name", F.col("value").cast("string")), F.col("path"), [F.concat(F.lit("node: "), "id")], f"Bring {c['metric']} to {c['threshold']} or less.")
    if rule["type"] == "impact_threshold":
        kinds = c.get("target_kind") or []
        own = change.modified
        if c.get("target_pattern"):
            n = nodes.where(F.col("path").isNull() | (F.col("path") == "") | any_glob(F.col("path"), [c["target_pattern"]]))
            own = own.join(n.select("id"), "id", "left_semi")
        found = guardrails.impact_threshold(nodes, edges, own, int(c["max_impact"]), int(c.get("max_hops", 3)), [kinds] if isinstance(kinds, str) else kinds).join(nodes.select("id", "name", "path"), "id")
        return _violations(found, rule, text(f"%s has %s dependants, over {c['max_impact']}", "name", F.col("total").cast("string")), F.col("path"), [F.concat(F.lit("node: "), "id")], "Split the change or put a layer between.")
    if rule["type"] == "file_scope_ban":
        found = guardrails.file_scope_ban(change.files, c["path_pattern"])
        return _violations(found, rule, text(f"File %s is in the protected scope '{c['path_pattern']}'", "path"), F.col("path"), fix="Ask a person to review this file's change.")
    raise ValueError(f"no handler for rules of type {rule['type']}")


def evaluate(nodes: DataFrame, edges: DataFrame, change: ChangeSet, rules: list[dict]) -> DataFrame:
    """The violations of all rules (see VIOLATION). A rule whose definition is wrong is left out with a warning; the others count.

    What fails while a rule's job runs is raised, as a change must not pass for want of a disk. There are few rules; each one's
    violations are written to the shared folder.
    """
    spark = nodes.sparkSession
    found = [spark.createDataFrame([], VIOLATION)]
    for rule in rules:
        try:
            broken = _check(rule, nodes, edges, change)
        except (KeyError, TypeError, ValueError) as e:
            log.warning("rule %s is left out: %r", rule.get("id"), e)
            continue
        found.append(materialize(broken))
    return reduce(DataFrame.unionByName, found)


def review_reasons(nodes: DataFrame, edges: DataFrame, change: ChangeSet, conditions: list[dict]) -> DataFrame:
    """reason: why a person has to review a change, at most one for each of a policy's conditions.

    impact_count (threshold, 15 if none): the modified node with the most dependants. cross_repo: a new edge of a kind
    between repositories. modifies_api: a modified endpoint.
    """
    spark = nodes.sparkSession
    out = [spark.createDataFrame([], "reason string")]
    for c in conditions:
        if c["type"] == "impact_count":
            most = int(c.get("threshold") or 15)
            big = guardrails.impact_threshold(nodes, edges, change.modified, most).orderBy(F.desc("total"), "id").limit(1)
            out.append(big.select(F.format_string(f"%s has %s dependants, over {most}", "id", F.col("total").cast("string")).alias("reason")))
        elif c["type"] == "cross_repo":
            cross = change.new_edges.where(F.col("kind").isin(*graph.CROSS_REPO_KINDS)).limit(1)
            out.append(cross.select(F.lit("The change adds dependencies between repositories").alias("reason")))
        elif c["type"] == "modifies_api":
            ends = nodes.where("kind = 'api_endpoint'").join(change.modified, "id", "left_semi").orderBy("seq", "id").limit(1)
            out.append(ends.select(F.concat(F.lit("The change modifies the endpoint "), "name").alias("reason")))
    return reduce(DataFrame.unionByName, out)
