"""Summaries and embedding texts of nodes from their neighbours, with list caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SYMBOL_KINDS
from ..sources.shared import materialize

#: How many callees and callers, bases, children in a summary and in an embedding text; how many letters (fixed values).
NAMES, BASES, CHILDREN, EMBEDDED_CHILDREN = 10, 5, 20, 30
DOC, CHILD_DOC, SUMMARY, TEXT = 200, 80, 500, 4000


def _first(links: DataFrame, value: Column, most: int | None, name: str) -> DataFrame:
    """links(of, seq, id, ...) -> of, name: the values of each node's first `most` neighbours, in order.

    Only rows within the cap are gathered, so a hub's neighbours are never one list. Without one the list is as long as its
    container, as for the members of a module or repository, which their text all names.
    """
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("of").orderBy("seq", "id"))
    rows = links.withColumn("_rn", rn)
    rows = rows.where(F.col("_rn") <= most) if most else rows
    return rows.groupBy("of").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", value.alias("_v")))), lambda x: x["_v"]).alias(name))


def _neighbours(nodes: DataFrame, edges: DataFrame, kind: str, incoming: bool = False, only: DataFrame | None = None) -> DataFrame:
    near, far = ("target", "source") if incoming else ("source", "target")
    n = nodes.select("id", "name", "signature", "docstring", "seq")
    links = edges.where(F.col("kind") == kind).select(F.col(near).alias("of"), F.col(far).alias("id"))
    links = links.join(only.select(F.col("id").alias("of")), "of", "left_semi") if only is not None else links
    return links.distinct().join(n, "id")


def _label() -> Column:
    return F.coalesce(F.nullif("signature", F.lit("")), F.col("name"))


def _text(label: str, names: str) -> Column:
    return F.when(F.size(names) > 0, F.concat(F.lit(label), F.array_join(names, ", ")))


def _route() -> Column:
    return F.when((F.col("http_method") != "") & (F.col("route_path") != ""), F.concat(F.lit("Route: "), "http_method", F.lit(" "), "route_path"))


def _with(nodes: DataFrame, edges: DataFrame, children: int | None, child: Column, only: DataFrame | None) -> DataFrame:
    n = nodes.join(only.select("id"), "id", "left_semi") if only is not None else nodes
    near = lambda kind, incoming=False: _neighbours(nodes, edges, kind, incoming, only)
    parts = {"callees": _first(near("calls"), F.col("name"), NAMES, "callees"), "callers": _first(near("calls", True), F.col("name"), NAMES, "callers"), "children": _first(near("contains"), child, children, "children")}
    for name, df in parts.items():
        n = n.join(df.withColumnRenamed("of", "id"), "id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return n


#: Edges that a summary or an embedding text tells of; of calls both ends tell, of the others only the source.
TOLD = ("contains", "calls", "inherits", "implements")


def stale(before: DataFrame, after: DataFrame, touched: DataFrame) -> DataFrame:
    """id of the nodes whose summary or embedding text may differ between two states of a graph's edges(source, target, kind).

    touched(id) are the nodes that came, went or were read anew. Besides them it is what tells of them, the ends of edges that
    came or went, and what names how many a container with such edges holds. Both states are scanned, in narrow rows.
    """
    told = lambda df, bit: df.where(F.col("kind").isin(*TOLD)).select("source", "target", "kind", F.lit(bit).alias("b"))
    both = materialize(told(before, 1).unionByName(told(after, 2)).groupBy("source", "target", "kind").agg(F.bit_or("b").alias("b")))
    new = materialize(touched.select("id").distinct())
    moved = both.where("b != 3")
    at = both.join(new.withColumnRenamed("id", "target"), "target", "left_semi").select("source")
    called = both.where("kind = 'calls'").join(new.withColumnRenamed("id", "source"), "source", "left_semi").select("target")
    sized = moved.where("kind = 'contains'").select(F.col("source").alias("target"))
    above = both.where("kind = 'contains'").join(sized, "target", "left_semi").select("source")
    ids = new.unionByName(moved.select(F.col("source").alias("id"))).unionByName(moved.where("kind = 'calls'").select(F.col("target").alias("id")))
    for df in (at, called, above):
        ids = ids.unionByName(df.toDF("id"))
    return materialize(ids.distinct())


def heuristic_summaries(nodes: DataFrame, edges: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """id, summary of each node(id, kind, name, path, signature, docstring, http_method, route_path, seq) by its kind.

    Functions: signature, document, callees, callers, route. Files: their symbols. Modules and repositories: their members
    with how many each has. Other kinds have their name. With only(id), distinct ids, just theirs are worked out.
    """
    doc = F.when(F.col("docstring") != "", F.concat(F.lit(" — "), F.substring("docstring", 1, CHILD_DOC))).otherwise(F.lit(""))
    n = _with(nodes, edges, CHILDREN, F.concat(F.lit("  "), _label(), doc), only)
    inside = edges.where("kind = 'contains'")
    if only is not None:
        inside = inside.join(_neighbours(nodes, edges, "contains", only=only).select(F.col("id").alias("source")), "source", "left_semi")
    sizes = inside.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("size"))
    members = _neighbours(nodes, edges, "contains", only=only).join(sizes, "id", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    n = n.join(_first(members, F.struct("name", "size"), None, "members").withColumnRenamed("of", "id"), "id", "left")
    member = lambda before, after: F.array_join(F.transform("members", lambda m: F.concat(F.lit("\n  "), m["name"], F.lit(before), m["size"].cast("string"), F.lit(after))), "")
    filled = lambda c, k=None: F.nullif(F.substring(c, 1, k) if k else F.col(c), F.lit(""))
    call = F.concat_ws("\n", filled("signature"), filled("docstring", DOC), _text("Calls: ", "callees"), _text("Called by: ", "callers"), _route())
    file = F.concat_ws("\n", F.concat(F.lit("File: "), F.coalesce("path", F.lit(""))), F.when(F.size("children") > 0, F.array_join("children", "\n")))
    module = F.concat(F.lit("Module: "), "name", F.coalesce(member(" (", " symbols)"), F.lit("")))
    repository = F.concat(F.lit("Repository: "), "name", F.coalesce(member("/ (", " files)"), F.lit("")))
    kind = F.col("kind")
    out = F.when(kind.isin("function", "method", "api_endpoint"), call).when(kind == "file", file).when(kind == "module", module).when(kind == "repository", repository)
    return n.select("id", F.coalesce(F.nullif(out, F.lit("")), F.col("name")).alias("summary"))


def embedding_texts(nodes: DataFrame, edges: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """id, text to embed: a symbol's code with its context, or a container's path, children and the start of its summary; at most TEXT
    letters. With only(id), distinct ids, just theirs are worked out."""
    n = _with(nodes, edges, EMBEDDED_CHILDREN, _label(), only)
    for kind in ("inherits", "implements"):
        n = n.join(_first(_neighbours(nodes, edges, kind, only=only), F.col("name"), BASES, kind).withColumnRenamed("of", "id"), "id", "left")
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    context = F.concat_ws(
        "\n", F.concat(F.lit("File: "), filled("path")), _route(), F.concat(F.lit("Doc: "), F.nullif(F.substring("docstring", 1, DOC), F.lit(""))), _text("Calls: ", "callees"), _text("Called by: ", "callers"),
        _text("Inherits: ", "inherits"), _text("Implements: ", "implements"),
    )
    code = F.coalesce(filled("raw_code"), filled("signature"), F.col("name"))
    symbol = F.when(context != "", F.concat(code, F.lit("\n\n# Context\n"), context)).otherwise(code)
    parts = F.concat_ws("\n", filled("path"), F.when(F.size("children") > 0, F.array_join("children", "\n")))
    box = F.when(parts != "", F.concat_ws("\n", parts, F.nullif(F.substring("summary", 1, SUMMARY), F.lit("")))).otherwise(F.col("name"))
    return n.select("id", F.substring(F.when(F.col("kind").isin(*SYMBOL_KINDS), symbol).otherwise(box), 1, TEXT).alias("text"))
