"""Results as text: one row for each line, or one row with all of them. Inputs are results that a budget or a top-k has cut."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import detect_language


def _lines(*parts: DataFrame) -> DataFrame:
    """part, ord, line of several (ord, line) tables, one after the other."""
    return reduce(DataFrame.unionByName, (p.select(F.lit(k).alias("part"), F.col("ord").cast("string").alias("ord"), "line") for k, p in enumerate(parts)))


def text(lines: DataFrame) -> DataFrame:
    """One row, text: the lines in order."""
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "ord", "line"))), lambda x: x["line"]), "\n").alias("text"))


def _line(df: DataFrame, line: Column, order: Column | None = None) -> DataFrame:
    return df.select((F.lit("") if order is None else order).alias("ord"), line.alias("line"))


def _place(n: Column, width: int = 9) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _section(rows: DataFrame, title: str, line: Column, order: Column) -> DataFrame:
    """A title and a line for each row; nothing without rows."""
    head = rows.limit(1).select(F.lit("").alias("ord"), F.lit(title).alias("line"))
    return head.unionByName(_line(rows, line, order))


def _where(path: str = "path") -> Column:
    return F.when(F.col(path) != "", F.concat(F.lit(" ("), path, F.lit(")"))).otherwise(F.lit(""))


def _badge() -> Column:
    block = F.col("severity") == "block"
    return F.when(block & (F.col("approval_status") == "approved"), "BLOCK (approved)").when(block & (F.col("approval_status") == "pending"), "BLOCK (pending)").otherwise(F.upper("severity"))


def rule_report(violations: DataFrame, rules: int, files: int, markdown: bool = False) -> DataFrame:
    """Lines of a check: its state, counts and violations(rule_id, severity, message, file_path, suggested_fix, approval_status)."""
    pending = (F.col("severity") == "block") & (F.coalesce("approval_status", F.lit("pending")) != "approved")
    sums = violations.agg(F.count("*").alias("n"), F.count_if(pending).alias("open"))
    state = F.when(F.col("open") == 0, "passed").otherwise("failed")
    key = F.concat_ws("|", "rule_id", "file_path", "message")
    if not markdown:
        head = _line(sums, F.concat(F.lit("Check "), state, F.lit(f"\n  Rules: {rules}\n  Files: {files}\n  Violations: "), F.col("n").cast("string")))
        body = F.concat(F.lit("  "), _badge(), F.lit(" ["), "rule_id", F.lit("] "), "message", F.coalesce(F.concat(F.lit("\n    File: "), "file_path"), F.lit("")), F.coalesce(F.concat(F.lit("\n    Fix: "), F.nullif("suggested_fix", F.lit(""))), F.lit("")))
        return _lines(head, _line(violations, body, key))
    head = _line(sums, F.concat(F.lit("## Check "), state, F.lit(f"\n\nRules: {rules}, files: {files}, violations: "), F.col("n").cast("string")))
    row = F.concat(F.lit("| "), _badge(), F.lit(" | `"), "rule_id", F.lit("` | "), "message", F.lit(" | "), F.coalesce(F.concat(F.lit("`"), "file_path", F.lit("`")), F.lit("-")), F.lit(" |"))
    table = _section(violations, "\n| Severity | Rule | Details | File |\n|-|-|-|-|", row, key)
    fixes = violations.where("suggested_fix != ''").groupBy("rule_id", "suggested_fix").agg(F.lit(1))
    return _lines(head, table, _section(fixes, "\nFixes:\n", F.concat(F.lit("- "), "rule_id", F.lit(": "), "suggested_fix"), F.col("rule_id")))


def rule_json(violations: DataFrame) -> DataFrame:
    """json of each violation."""
    return violations.select(F.to_json(F.struct(*violations.columns)).alias("json"))


def bundle_text(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a search result, nodes(ord, id, repo, path, start_line, end_line, raw_code, summary), by repository, with up to five links of each."""
    tail = lambda c: F.substring_index(c, "::", -1)
    ends = edges.select(F.col("source").alias("id"), F.concat("kind", F.lit(": "), tail("target")).alias("note")).unionByName(edges.select(F.col("target").alias("id"), F.concat(F.lit("from: "), tail("source")).alias("note")))
    rn = F.row_number().over(Window.partitionBy("id").orderBy("note"))
    notes = ends.withColumn("rn", rn).where("rn <= 5").groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("note")), " | ").alias("notes"))
    lines = F.when(F.col("start_line").isNotNull(), F.format_string(" (lines %s-%s)", F.col("start_line").cast("string"), F.col("end_line").cast("string"))).otherwise(F.lit(""))
    body = F.coalesce(F.nullif("raw_code", F.lit("")), F.concat(F.lit("# Summary: "), F.nullif("summary", F.lit(""))))
    line = F.concat_ws("\n", F.concat(F.lit("```"), detect_language(F.coalesce("path", F.lit("")))), F.concat(F.lit("# "), F.concat_ws(":", "repo", F.nullif("path", F.lit(""))), lines), F.concat(F.lit("# "), "notes"), body, F.lit("```"))
    head = _line(nodes.select("repo").distinct(), F.concat(F.lit("### "), "repo"), F.col("repo"))
    rows = _line(nodes.join(notes, "id", "left"), line, F.concat("repo", F.lit("\1"), _place(F.col("ord"))))
    return _lines(head.unionByName(rows))


def impact_text(roles: DataFrame, nodes: DataFrame) -> DataFrame:
    """Lines of impact_roles() of one target: callers, users, implementers, and up to 15 nodes of each later hop."""
    named = roles.join(nodes.select("id", "name", "path"), "id")
    line, order = F.concat(F.lit("- `"), "name", F.lit("`"), _where()), F.concat_ws("|", "name", "id")
    rn = F.row_number().over(Window.partitionBy("hop").orderBy("name", "id"))
    later = named.where("role = 'transitive'").withColumn("rn", rn).where("rn <= 15")
    sums = roles.where("role = 'transitive'").groupBy("hop").agg(F.count("*").alias("n"))
    hops = _line(sums, F.format_string("Hop %s (%s nodes):", F.col("hop").cast("string"), F.col("n").cast("string")), _place(F.col("hop")))
    hops = hops.unionByName(_line(later, F.concat(F.lit("  "), line), F.concat(_place(F.col("hop")), F.lit("|"), order)))
    head = _line(roles.agg(F.count("*").alias("n")), F.concat(F.lit("Impacted: "), F.col("n").cast("string")))
    return _lines(head, *(_section(named.where(F.col("role") == r), t, line, order) for r, t in (("caller", "### Callers"), ("user", "### Users"), ("implementer", "### Implementers"))), hops)


def context_text(context: DataFrame, nodes: DataFrame) -> DataFrame:
    """Lines of write_context() of one file, a section for each role."""
    named = context.select("role", "id").join(nodes.select("id", "name", "path", "kind"), "id")
    titles = {"symbol": "Symbols", "interface": "Interfaces", "sibling": "Siblings", "test": "Tests", "wiring": "Wiring", "imports": "Imports", "imported_by": "Imported by"}
    line = F.concat(F.lit("- `"), "name", F.lit("` "), "kind", _where())
    return _lines(*(_section(named.where(F.col("role") == r), f"### {t}", line, F.concat_ws("|", "name", "id")) for r, t in titles.items()))


def quality_text(overview: DataFrame, gaps: DataFrame, most: int = 20) -> DataFrame:
    """Lines of quality.overview() and the first of quality.gaps()."""
    head = _line(overview, F.format_string("Nodes: %s\nMean quality: %.2f\nGaps: %s", F.col("total").cast("string"), F.col("mean"), F.col("gaps").cast("string")))
    few = gaps.orderBy("quality", "id").limit(most)
    return _lines(head, _line(few, F.format_string("- `%s` (quality %.2f): %s", "id", "quality", "reasons"), F.concat(F.format_string("%.6f", "quality"), F.lit("|"), F.col("id"))))


def catalog_text(services: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Lines of service_rows() and dependency_map(): a block for each repository."""
    deps = dependencies.where("direction = 'out'").groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set(F.concat("other", F.lit(" ("), "kind", F.lit(")")))), ", ").alias("deps"))
    head = F.concat(F.lit("## "), "repo", F.format_string("\nNodes: %s, files: %s, symbols: %s", *(F.col(c).cast("string") for c in ("nodes", "files", "symbols"))))
    return _lines(_line(services.join(deps, "repo", "left"), F.concat(head, F.coalesce(F.concat(F.lit("\nDependencies: "), "deps"), F.lit(""))), F.col("repo")))


def drift_text(found: DataFrame) -> DataFrame:
    """Lines of drift(): its share, then the names of each status."""
    head = _line(found.agg(F.avg((F.col("status") != "ok").cast("double")).alias("s")), F.format_string("Drift: %.1f%%", F.coalesce("s", F.lit(0.0)) * 100))
    line = F.concat(F.lit("- "), "name")
    return _lines(head, *(_section(found.where(F.col("status") == s), t, line, F.col("name")) for s, t in (("ok", "Confirmed"), ("undeclared", "Undeclared"), ("missing", "Missing in code"))))
