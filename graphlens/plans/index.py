"""Indexing: files to a linked graph, as a whole or for the files that changed."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import basename, detect_language, normalize_route, symbol_kind
from ..operators import catalog, embed, link, summaries
from ..sources import git, parse
from ..sources.kept import Kept
from ..sources.shared import materialize
from ..sources.snapshots import Replace, Store, View

NODE = "id string, repo string, kind string, name string, path string, start_line int, end_line int, raw_code string, signature string, docstring string, http_method string, route_path string, seq long"


#: Who defines a name and who mentions it, and whose client calls may mean a route, by file and looked up by name or route.
DEFINITIONS = Kept("definitions", "repo string, path string, name string, target string, target_kind string", ("repo", "path"), "name")
MENTIONS = Kept("mentions", "repo string, path string, name string, source string, own string, base boolean", ("repo", "path"), "name")
ROUTES = Kept("client_routes", "repo string, path string, name string, source string", ("repo", "path"), "name")
_NAMED = ("calls", "uses_type", "inherits")
#: Kinds of edges that indexing finds itself; others, of an adopted graph, stay while both their ends do.
_FOUND = (*_NAMED, "contains", "api_calls", "shared_lib")
_COLUMNS = [x.split()[0] for x in NODE.split(", ")]


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame


def _null(*names: str) -> list:
    kinds = dict(x.split() for x in NODE.split(", "))
    return [F.lit(None).cast(kinds[n]).alias(n) for n in names]


def build(files: DataFrame) -> Graph:
    """Nodes and containment of files(repo, path, content): repositories, modules, files and symbols.

    Only files with symbols are nodes, and only modules above them. A symbol with a route decorator is an endpoint. Methods
    belong to the class whose lines hold them, the innermost; ids that repeat in a file are numbered in order.
    """
    symbols = parse.symbols(files).withColumn("base", F.concat("repo", F.lit(":"), "path", F.lit("::"), "name"))
    symbols = materialize(parse.unique_ids(symbols))
    end = catalog.endpoint(F.concat_ws("\n", F.array_join("decorators", "\n"), F.col("code")))
    place = F.xxhash64("repo", "path").bitwiseAND((1 << 42) - 1) * (1 << 20)  # an order that other files do not change
    own = symbols.withColumn("e", end).select(
        "id", "repo", F.when(F.col("e").isNotNull(), "api_endpoint").otherwise(symbol_kind(F.col("kind"))).alias("kind"), "name", "path", "start_line", "end_line", F.col("code").alias("raw_code"), "signature", "docstring",
        F.col("e.method").alias("http_method"), F.col("e.path").alias("route_path"), (place + F.col("seq") + 1).alias("seq"),
    )
    parsed = symbols.select("repo", "path").distinct()
    file = parsed.select(F.concat("repo", F.lit(":"), "path").alias("id"), "repo", F.lit("file").alias("kind"), basename(F.col("path")).alias("name"), "path", *_null("start_line", "end_line", "raw_code", "signature", "docstring", "http_method", "route_path"), place.alias("seq"))
    dirs = parse.modules(parsed)
    module = dirs.select(F.concat("repo", F.lit(":"), "path", F.lit("/")).alias("id"), "repo", F.lit("module").alias("kind"), basename(F.col("path")).alias("name"), "path", *_null("start_line", "end_line", "raw_code", "signature", "docstring", "http_method", "route_path"), F.lit(1).cast("long").alias("seq"))
    repo = files.select("repo").distinct().select(F.concat("repo", F.lit(":")).alias("id"), "repo", F.lit("repository").alias("kind"), F.col("repo").alias("name"), *_null("path", "start_line", "end_line", "raw_code", "signature", "docstring", "http_method", "route_path"), F.lit(0).cast("long").alias("seq"))
    nodes = materialize(repo.unionByName(module).unionByName(file).unionByName(own))

    above = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    parent = F.concat("repo", F.lit(":"), F.when(above != "", F.concat(above, F.lit("/"))).otherwise(F.lit("")))
    edge = lambda source, target: (source.alias("source"), target.alias("target"), F.lit("contains").alias("kind"))
    contains = file.unionByName(module).select(*edge(parent, F.col("id")))
    inner = own.select("repo", "path", F.col("id").alias("target"), "start_line", "end_line")
    outer = own.where("kind = 'class'").select("repo", "path", F.col("id").alias("outer"), F.col("start_line").alias("lo"), F.col("end_line").alias("hi"))
    held = inner.join(outer, ["repo", "path"], "left").withColumn("holds", (F.col("lo") <= F.col("start_line")) & (F.col("hi") >= F.col("end_line")) & (F.col("outer") != F.col("target")))
    held = held.groupBy("repo", "path", "target").agg(F.min_by("outer", F.when(F.col("holds"), F.col("hi") - F.col("lo"))).alias("outer"))
    contains = contains.unionByName(held.select(*edge(F.coalesce("outer", F.concat("repo", F.lit(":"), "path")), F.col("target"))))
    return Graph(nodes, materialize(contains))


def _code(nodes: DataFrame) -> DataFrame:
    """The nodes whose code is linked."""
    return nodes.where("raw_code != ''").select("id", "name", "kind", "repo", "path", "raw_code", "signature", "route_path", "seq")


def _said(code: DataFrame) -> DataFrame:
    """code with strings and comments taken out, so that only what is said in code links."""
    language = detect_language(F.col("path"))
    bare = parse.code_of(code.select("id", F.col("raw_code").alias("code"), language.alias("language")), ["id"])
    return code.drop("raw_code").join(bare.withColumnRenamed("code", "raw_code"), "id")


def _of_files(links: DataFrame, end: str, nodes: DataFrame) -> DataFrame:
    """Definitions or mentions with the file of the node at `end`."""
    return links.join(nodes.select(F.col("id").alias(end), "repo", "path"), end)


def _calls(code: DataFrame, nodes: DataFrame) -> DataFrame:
    return link.api_contracts(code, nodes.where("kind = 'api_endpoint'")).select("source", "target", F.lit("api_calls").alias("kind"))


def _finished(nodes: DataFrame, edges: DataFrame) -> Graph:
    """With shared imports and each node's summary."""
    edges = materialize(edges.unionByName(link.shared_imports(nodes, edges)).distinct())
    return Graph(nodes.join(summaries.heuristic_summaries(nodes, edges), "id", "left"), edges)


def _refreshed(view: View, new_nodes: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[Graph, DataFrame]:
    """_finished() after a change, and the ids whose texts may be others; the summaries of the rest are those of before."""
    edges = materialize(edges.unionByName(link.shared_imports(nodes, edges)).distinct())
    before = view.load("nodes")
    box = F.col("kind").isin("module", "repository")
    came = new_nodes.where(~box).select("id").unionByName(new_nodes.where(box).select("id").join(before.select("id"), "id", "left_anti"))
    went = before.select("id").join(nodes.select("id"), "id", "left_anti")
    stale = summaries.stale(view.load("edges"), edges, came.unionByName(went))
    if "summary" not in before.columns:  # an adopted graph that has none yet
        stale = materialize(nodes.select("id").unionByName(went))
        before = before.withColumn("summary", F.lit(None).cast("string"))
    made = summaries.heuristic_summaries(nodes, edges, stale)
    kept = before.select("id", "summary").join(stale, "id", "left_anti")
    return Graph(materialize(nodes.join(made.unionByName(kept), "id", "left")), edges), stale


def linked(g: Graph) -> Graph:
    """With cross-references, calls of endpoints and shared imports, and each node's summary."""
    code = _code(g.nodes)
    return _finished(g.nodes, g.edges.unionByName(link.link_names(_said(code))).unionByName(_calls(code, g.nodes)))


def timed(nodes: DataFrame, times: DataFrame | None, old: DataFrame | None = None) -> DataFrame:
    """nodes with last_modified and modification_count of their file by times(repo, path, last_modified, modification_count).

    Of nodes whose file times has not, or without times, old's stay; nodes that neither knows have none and a count of 0.
    """
    spark = nodes.sparkSession
    none = spark.createDataFrame([], "id string, last_modified timestamp, modification_count int")
    old = none if old is None or not {"last_modified", "modification_count"} <= set(old.columns) else old
    old = old.select("id", F.col("last_modified").alias("_at"), F.col("modification_count").alias("_n"))
    times = times if times is not None else spark.createDataFrame([], "repo string, path string, last_modified timestamp, modification_count int")
    times = times.select("repo", "path", F.col("last_modified").cast("timestamp"), F.col("modification_count").cast("int"))
    both = nodes.join(times, ["repo", "path"], "left").join(old, "id", "left")
    at, n = F.coalesce("last_modified", "_at"), F.coalesce("modification_count", "_n", F.lit(0))
    return both.withColumns({"last_modified": at, "modification_count": n}).select(*nodes.columns, "last_modified", "modification_count")


VECTOR = "id string, embedding array<float>, repo string, kind string, path string, document string"


def hydrated(view: View, nodes: DataFrame, edges: DataFrame, stale: DataFrame | None = None) -> dict:
    """What a commit writes so that each node has the vector of its text: those of nodes that are gone go, and only nodes without
    a vector, or whose text is another than their vector's, are embedded. The first call fits the model, later ones use it.

    With stale(id), texts are made only for those and for nodes without a vector; the vectors of the others stay."""
    have = view.load("vectors", VECTOR).select(*(c.split()[0] for c in VECTOR.split(", ")))
    known = bool(view.tables.get("embedding_model"))
    asked, stay = None, have.limit(0)
    if stale is not None and known:
        asked = materialize(stale.select("id").unionByName(nodes.select("id").join(have.select("id"), "id", "left_anti")).distinct())
        stay = have.join(asked, "id", "left_anti").join(nodes.select("id"), "id", "left_semi").select(have.columns)
    texts = materialize(summaries.embedding_texts(nodes, edges, asked).withColumn("text", F.coalesce("text", F.lit(""))))
    model = view.load("embedding_model", embed.MODEL) if known else materialize(embed.fit(texts))
    same = materialize(have.join(texts, "id").where("document = text").select(have.columns))
    missing = texts.join(same.select("id"), "id", "left_anti")
    stay = stay.unionByName(same)
    new = embed.embed(missing, model).join(texts, "id").join(nodes.select("id", "repo", "kind", "path"), "id").select("id", "embedding", "repo", "kind", "path", F.col("text").alias("document"))
    return {"vectors": stay.unionByName(new.select(stay.columns)), **({} if known else {"embedding_model": model})}


def hydrate(store: Store) -> int:
    """Embeds the nodes of the stored graph that have no vector of their text; how many they were."""
    made = []

    def change(view: View) -> dict:
        before = view.load("vectors", VECTOR).select("id", "document")
        out = hydrated(view, view.load("nodes"), view.load("edges"))
        out["vectors"] = materialize(out["vectors"])
        made[:] = [out["vectors"].join(before, ["id", "document"], "left_anti").count()]
        changed = made[0] or out["vectors"].count() != before.count()
        return out if changed else {}

    store.commit(change)
    return made[0]


def _whole(kept: Kept, view: View, rows: DataFrame) -> dict:
    """The table of an index anew, without marks."""
    nobody = view.store.spark.createDataFrame([], kept.marks)
    fresh = kept.delta(view, rows, nobody)
    return {kept.name: Replace(fresh[kept.name].rows, fresh[kept.name].by), kept.gone: Replace(nobody)}


def adopt(store: Store, g: Graph, vectors: bool = False) -> None:
    """Stores a linked graph with the index of its names, and the vectors of its texts, in one commit."""
    code = materialize(_code(g.nodes))
    names = materialize(_of_files(link.definitions(code), "target", code)), materialize(_of_files(link.mentions(_said(code)), "source", code))
    routes = materialize(_of_files(link.meant_routes(code), "source", code))
    store.commit(lambda view: {"nodes": g.nodes, "edges": g.edges, **_whole(DEFINITIONS, view, names[0]), **_whole(MENTIONS, view, names[1]), **_whole(ROUTES, view, routes), **(hydrated(view, g.nodes, g.edges) if vectors else {})})


def index_all(store: Store, files: DataFrame, times: DataFrame | None = None, vectors: bool = True) -> Graph:
    """Builds the graph of all files and stores nodes, edges, the index of names and (unless told otherwise) vectors in one commit.

    times, as sources.git.file_times gives them, are the files' last changes and counts.
    """
    g = linked(build(files))
    g = Graph(materialize(timed(g.nodes, times)), g.edges)
    adopt(store, g, vectors)
    return g


def relinked(view: View, kept_nodes: DataFrame, new_nodes: DataFrame, gone: DataFrame) -> tuple[DataFrame, dict]:
    """(name links and calls of the changed graph, what a commit writes) for the new nodes in place of those of the files gone(repo, path).

    Only names whose definitions changed, which may cross the limit of definitions, and names that new code mentions are
    looked up; links of other names stay. Calls of endpoints are found for new code and for what may mean a route whose
    endpoints changed.
    """
    old = view.load("nodes").select(_COLUMNS)
    removed = materialize(old.join(gone, ["repo", "path"], "left_semi").select("id", "name", "kind", "raw_code", "route_path"))
    code = materialize(_code(new_nodes))
    fresh_defs, fresh_mentions = materialize(_of_files(link.definitions(code), "target", code)), materialize(_of_files(link.mentions(_said(code)), "source", code))
    changed = materialize(removed.where("raw_code != ''").select("name").unionByName(fresh_defs.select("name")).distinct())
    asked = materialize(changed.unionByName(fresh_mentions.select("name")).distinct())

    def now(kept: Kept, names: DataFrame, fresh: DataFrame) -> DataFrame:
        """The rows of these names once the delta is in."""
        rows = kept.read(view, names).join(gone, ["repo", "path"], "left_anti")
        return rows.select(kept.columns).unionByName(fresh.join(names, "name", "left_semi").select(kept.columns))

    targets = materialize(now(DEFINITIONS, asked, fresh_defs))
    sources = now(MENTIONS, changed, fresh_mentions).unionByName(fresh_mentions.select(MENTIONS.columns)).distinct()
    links = link.joined_names(sources.select("source", "own", "base", "name"), targets.select("name", "target", "target_kind"))
    edges = view.load("edges").select("source", "target", "kind")
    dead = removed.select("id")
    stay = edges.where(F.col("kind").isin(*_NAMED))
    renamed = old.join(changed, "name", "left_semi").select(F.col("id").alias("target"))  # their links are found anew
    stay = stay.join(dead.withColumnRenamed("id", "source"), "source", "left_anti").join(renamed, "target", "left_anti")
    nodes = kept_nodes.unionByName(new_nodes.select(kept_nodes.columns))
    calls, index = _called(view, edges, nodes, code, removed, gone)
    other = edges.where(~F.col("kind").isin(*_FOUND)).join(dead.withColumnRenamed("id", "source"), "source", "left_anti").select("source", "target", "kind")
    found = stay.select("source", "target", "kind").unionByName(links).unionByName(calls).unionByName(other).distinct()
    return found, {**DEFINITIONS.delta(view, fresh_defs, gone), **MENTIONS.delta(view, fresh_mentions, gone), **index}


def _called(view: View, edges: DataFrame, nodes: DataFrame, code: DataFrame, removed: DataFrame, gone: DataFrame) -> tuple[DataFrame, dict]:
    """(calls of endpoints, what a commit writes of their index) for new code in place of what was removed.

    Only sources with a call that may mean a route whose endpoints came or went are linked anew; the calls of others stay.
    """
    if not view.exists(ROUTES.name):  # a store of before there was this index
        every = _code(nodes)
        return _calls(every, nodes), _whole(ROUTES, view, _of_files(link.meant_routes(every), "source", every))
    end = F.col("kind") == "api_endpoint"
    routes = removed.where(end).select("route_path").unionByName(code.where(end).select("route_path")).where("route_path != ''")
    routes = materialize(routes.select(normalize_route(F.col("route_path")).alias("name")).distinct())
    touched = ROUTES.read(view, routes).join(gone, ["repo", "path"], "left_anti").select(F.col("source").alias("id")).distinct()
    again = materialize(code.select("id").unionByName(touched).distinct())
    before = edges.where("kind = 'api_calls'").select("source", "target", "kind")
    for ids in (again, removed):
        before = before.join(ids.select(F.col("id").alias("source")), "source", "left_anti")
    calls = before.select("source", "target", "kind").unionByName(_calls(_code(nodes).join(again, "id", "left_semi"), nodes))
    return calls, ROUTES.delta(view, materialize(_of_files(link.meant_routes(code), "source", code)), gone)


def index_incremental(store: Store, changes: DataFrame, files: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """Applies changes(repo, status, old_path, new_path) with the files(repo, path, content) that they need to the stored graph.

    The nodes of removed paths go, those of parsed paths come, and what links by a changed name is linked anew, in old code
    too; the result is that of index_all. Nodes, edges and the index of names are one commit. Returns repo, added,
    modified, deleted, renamed.
    """
    steps = parse.file_changes(changes.withColumns({"old_path": F.concat_ws("\0", "repo", "old_path"), "new_path": F.concat_ws("\0", "repo", "new_path")}))
    steps = materialize(steps.select(F.substring_index("path", "\0", 1).alias("repo"), F.substring_index("path", "\0", -1).alias("path"), "action"))
    gone = materialize(steps.select("repo", "path").distinct())
    new = build(files.join(steps.where("action = 'parse'").select("repo", "path").distinct(), ["repo", "path"], "left_semi"))

    def change(view: View) -> dict:
        old = view.load("nodes").select(_COLUMNS)
        kept = old.where("kind IN ('module', 'repository')").unionByName(old.where("kind NOT IN ('module', 'repository')").join(gone, ["repo", "path"], "left_anti").select(old.columns))
        kept = materialize(kept.join(new.nodes.select("id"), "id", "left_anti").select(_COLUMNS))
        nodes = materialize(new.nodes.select(_COLUMNS).unionByName(kept))
        contains = view.load("edges").where("kind = 'contains'").select("source", "target", "kind").unionByName(new.edges).distinct()
        links, index = relinked(view, kept, new.nodes.select(_COLUMNS), gone)
        edges, ids = contains.unionByName(links), nodes.select("id")
        for end in ("source", "target"):
            edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
        g, stale = _refreshed(view, new.nodes, nodes, materialize(edges.select("source", "target", "kind").distinct()))
        vectors = hydrated(view, g.nodes, g.edges, stale) if view.exists("vectors") else {}
        return {"nodes": timed(g.nodes, times, view.load("nodes")), "edges": g.edges, **index, **vectors}

    store.commit(change)
    return catalog.index_report(changes)


def index_repository(store: Store, path: str, repo: str, extensions: Iterable[str], start: str = "HEAD") -> str | None:
    """Brings the stored graph of a git repository to the commit that start names; that commit, or None without commits.

    Only files that differ from the commit of the last time are read, from the repository's objects, and nodes get the times
    of the history. The commit is noted after the graph, so a run that fails between is made again, with the same result.
    """
    spark = store.spark
    head = git.Repository(path).resolve(start)
    if head is None:
        return None
    before = [r[0] for r in store.load("repo_state").where(F.col("repo_name") == repo).select("commit").collect()]
    if before == [head]:
        return head
    ends = tuple(extensions)
    ours = lambda c: F.coalesce(F.lower(F.regexp_extract(c, "(\\.[^./]+)$", 1)).isin(*ends), F.lit(False))
    changed = materialize(git.changed_between(spark, repo, path, before[0] if before else None, head).where(ours(F.col("old_path")) | ours(F.col("new_path"))))
    if changed.limit(1).count():
        files = materialize(git.contents(changed.where(ours(F.col("new_path"))), path))
        index_incremental(store, changed.drop("blob"), files, materialize(git.file_times(spark, {repo: path})))
    store.upsert("repo_state", spark.createDataFrame([(repo, head)], "repo_name string, commit string").withColumn("updated_at", F.current_timestamp()))
    return head
