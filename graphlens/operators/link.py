"""Links between symbols: names, inheritance, API calls, shared imports, test files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import basename, identifiers, normalize_route
from ..schemas import BASES, KEYWORDS
from ..sources.shared import materialize
from .blocks import reached
from .graph import first_by

#: Names with more definitions are never linked.
AMBIGUOUS = 20


def head_of(kind: Column, signature: Column, raw_code: Column) -> Column:
    """What names the bases of a class or type: its signature, else the first line of its code; empty for other kinds."""
    line = F.coalesce(F.nullif(signature, F.lit("")), F.substring_index(raw_code, "\n", 1), F.lit(""))
    return F.when(kind.isin("class", "type"), line).otherwise(F.lit(""))


def bases(signature: Column) -> Column:
    """Capitalised base names of a class signature: in parentheses, after a colon, after extends or implements."""

    def names(part: Column) -> Column:
        cut = F.transform(F.split(part, ","), lambda x: F.trim(F.regexp_extract(F.trim(x), "^[^<\\[(=]*", 0)))
        return F.filter(cut, lambda x: x.rlike("^[A-Z][A-Za-z0-9_]*$"))

    found = [names(F.regexp_extract(signature, p, 1)) for p in BASES]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def definitions(symbols: DataFrame) -> DataFrame:
    """symbols(id, name, kind) -> name, target, target_kind."""
    return symbols.select("name", F.col("id").alias("target"), F.col("kind").alias("target_kind"))


def mentions(symbols: DataFrame) -> DataFrame:
    """symbols(id, name, kind, raw_code, signature) -> source, own, base, name: each distinct identifier of a symbol's code; base if
    the symbol inherits it."""
    code = symbols.where("raw_code != ''").select(F.col("id").alias("source"), F.col("name").alias("own"), bases(head_of(F.col("kind"), F.col("signature"), F.col("raw_code"))).alias("bases"), F.explode(identifiers(F.col("raw_code"), KEYWORDS)).alias("name"))
    return code.select("source", "own", F.array_contains("bases", F.col("name")).alias("base"), "name")


def joined_names(found: DataFrame, targets: DataFrame, ambiguous: int = AMBIGUOUS) -> DataFrame:
    """source, target, kind of mentions and definitions by name; targets has all definitions of each of its names."""
    few = targets.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") <= ambiguous).select("name")
    kind = F.when(F.col("base"), "inherits").when(F.col("target_kind").isin("class", "type"), "uses_type").otherwise("calls")
    return found.join(targets.join(few, "name", "left_semi"), "name").where("name != own AND source != target").select("source", "target", kind.alias("kind")).distinct()


def link_names(symbols: DataFrame, existing: DataFrame | None = None, ambiguous: int = AMBIGUOUS) -> DataFrame:
    """symbols(id, name, kind, raw_code, signature) -> source, target, kind of new cross-references.

    Only classes and types inherit. An identifier of a symbol's code links to every symbol of that name unless it is its own name or has too many
    definitions. Bases inherit, classes and types are used, the rest is called. Each distinct identifier is one row.
    """
    out = joined_names(mentions(symbols), definitions(symbols), ambiguous)
    return out.join(existing.select("source", "target", "kind"), ["source", "target", "kind"], "left_anti") if existing is not None else out


def affected_links(symbols: DataFrame, new_ids: DataFrame, ambiguous: int = AMBIGUOUS) -> DataFrame:
    """Links of link_names that start or end at a new symbol: its mentions with all definitions, and all mentions of its name with it."""
    ids = new_ids.select("id").distinct()
    new = symbols.join(ids, "id", "left_semi")
    names = new.select("name").distinct()
    start = joined_names(mentions(new), definitions(symbols), ambiguous)
    targets = definitions(symbols.join(names, "name", "left_semi"))
    end = joined_names(mentions(symbols).join(names, "name", "left_semi"), targets, ambiguous).join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return start.unionByName(end.select(start.columns)).distinct()


def client_urls(code: Column) -> Column:
    """URLs of client calls: the first text in the call of a requests, httpx or aiohttp verb, or in fetch."""
    verbs = F.regexp_extract_all(code, F.lit("(?i)(?:requests|httpx|aiohttp)\\.(?:get|post|put|delete|patch)\\s*\\([^)\"']*[\"']([^\"']+)"), F.lit(1))
    fetch = F.regexp_extract_all(code, F.lit("(?i)fetch\\s*\\(\\s*[`\"']([^`\"']+)"), F.lit(1))
    return F.concat(verbs, fetch)


def client_routes(callers: DataFrame) -> DataFrame:
    """callers(id, repo, raw_code) -> source, repo, url, route of each distinct client call."""
    return callers.select(F.col("id").alias("source"), "repo", F.explode(client_urls(F.col("raw_code"))).alias("url")).distinct().withColumn("route", normalize_route(F.col("url")))


def route_ends(calls: DataFrame) -> DataFrame:
    """calls(route, ...) with route set to what follows each of its slashes: the routes that a call may mean besides its own."""
    behind = F.filter(F.sequence(F.lit(1), F.length("route")), lambda k: F.substring(F.col("route"), k, F.lit(1)) == "/")
    tails = F.transform(behind, lambda k: F.substring(F.col("route"), k + 1, F.length("route")))
    return calls.select(*(c for c in calls.columns if c != "route"), F.explode(tails).alias("route"))


def meant_routes(callers: DataFrame) -> DataFrame:
    """source, name: every route that a client call of the source may mean, its own and its ends."""
    calls = client_routes(callers).select("source", "route").distinct()
    return calls.unionByName(route_ends(calls)).select("source", F.col("route").alias("name")).where("name != ''").distinct()


def api_contracts(callers: DataFrame, endpoints: DataFrame) -> DataFrame:
    """callers(id, repo, raw_code) x endpoints(id, repo, route_path, seq) -> source, target, url of calls between repositories.

    Routes are normalised; of endpoints with one route the last inserted counts. A call takes the endpoint of an equal route,
    else the first inserted route that its own ends with behind a slash.
    """
    ends = endpoints.where("route_path != ''").select(normalize_route(F.col("route_path")).alias("route"), F.struct("seq", F.col("id").alias("target"), F.col("repo").alias("target_repo")).alias("e"))
    ends = ends.groupBy("route").agg(F.max("e").alias("last"), F.min("e.seq").alias("s")).select("route", "s", "last.target", "last.target_repo")
    calls = client_routes(callers)
    equal = calls.join(ends, "route").select("source", "repo", "url", "target", "target_repo")
    rest = calls.join(ends.select("route"), "route", "left_anti")
    found = route_ends(rest.select("source", "repo", "url", "route")).join(ends, "route").groupBy("source", "repo", "url").agg(F.min(F.struct("s", "route", "target", "target_repo")).alias("e"))
    found = equal.unionByName(found.select("source", "repo", "url", "e.target", "e.target_repo"))
    return found.where("repo != target_repo").select("source", "target", "url").distinct()


#: Words in the path of a file that wires others.
WIRING = ("container", "factory", "di", "module", "injector", "provider")


def write_context(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """files(id) -> file, role, id of what to know before an edit.

    Roles: symbol, interface (of a class or type), sibling (others with that interface by the edge kind that found it first),
    test, wiring (callers and users of a class from files that wire), imports, imported_by.
    """
    own = nodes.join(files.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("file"), "path")
    link = lambda *kinds: edges.where(F.col("kind").isin(*kinds)).select("source", "target", F.col("kind").alias("via"))
    sym = own.join(link("contains"), F.col("file") == F.col("source")).join(nodes.select(F.col("id").alias("sym"), F.col("kind").alias("k"), "seq"), F.col("target") == F.col("sym")).select("file", "sym", "k", "seq")
    up = sym.where("k IN ('class', 'type')").join(link("inherits", "implements"), F.col("sym") == F.col("source")).select("file", "sym", "seq", F.col("target").alias("iface"), "via")
    up = materialize(first_by(up, ["file", "iface"], [F.col("seq"), F.col("sym"), F.desc("via")]).select("file", "sym", "iface", "via"))
    ids = nodes.select("id").distinct()
    via = F.concat("via", F.lit(":"), "iface")  # one interface by two kinds is two
    near = link("inherits", "implements").join(ids, F.col("source") == F.col("id"), "left_semi").select(F.col("target").alias("iface"), "via", "source").select(via.alias("at"), F.col("source").alias("id"))
    sib = reached(up.select(F.col("file").alias("start"), via.alias("at"), F.col("sym").alias("but")), near, 1_024).select(F.col("start").alias("file"), F.lit("sibling").alias("role"), "id")
    wired = F.lit(False)
    for w in WIRING:
        wired = wired | F.contains(F.lower("path"), F.lit(w))
    wire = sym.where("k = 'class'").join(link("calls", "uses_type"), F.col("sym") == F.col("target")).select("file", "source").join(nodes.where(wired).select(F.col("id").alias("source")), "source")
    every = nodes.where("kind = 'file'").select("path", "seq", F.col("id").alias("test"))
    tests = own.join(test_files(own.select("path").distinct(), every), "path").join(every.select(F.col("path").alias("test_path"), "test"), "test_path")
    out = own.join(link("imports"), F.col("file") == F.col("source"))
    into = own.join(link("imports"), F.col("file") == F.col("target"))
    parts = {"symbol": (sym, "sym"), "interface": (up, "iface"), "test": (tests, "test"), "wiring": (wire, "source"), "imports": (out, "target"), "imported_by": (into, "source")}
    # each role's rows are made distinct where the join by id has put them
    found = [rows.select("file", F.col(end).alias("id")).join(ids, "id", "left_semi").select("file", "id").distinct().select("file", F.lit(name).alias("role"), "id") for name, (rows, end) in parts.items()]
    return reduce(DataFrame.unionByName, [*found, sib])


def shared_imports(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    from .graph import with_repos

    return with_repos(nodes, edges.where("kind = 'imports'")).where("source_repo != target_repo").select("source", "target", F.lit("shared_lib").alias("kind"))


def test_files(files: DataFrame, all_files: DataFrame) -> DataFrame:
    """files(path) -> path, test_path, the first (seq) file whose name is a test name of it by its extension."""
    base = basename(F.col("path"))
    ext = F.regexp_extract(base, "(\\.[^.]*)$", 1)
    stem = F.regexp_extract(base, "^(.*?)(\\.[^.]*)?$", 1)
    both = lambda a, b: F.array(a, b)
    join = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in p))
    names = (
        F.when(ext == ".swift", both(join(stem, "Tests.swift"), join(stem, "Test.swift")))
        .when(ext.isin(".ts", ".tsx", ".js", ".jsx"), both(join(stem, ".test", ext), join(stem, ".spec", ext)))
        .when(ext.isin(".kt", ".java"), F.array(join(stem, "Test", ext)))
        .when(ext == ".go", F.array(join(stem, "_test.go")))
        .when(ext == ".rs", F.array().cast("array<string>"))
        .otherwise(both(join("test_", stem, ext), join(stem, "_test", ext)))
    )
    wanted = files.select("path", F.explode(names).alias("base"))
    there = all_files.select(F.col("path").alias("test_path"), basename(F.col("path")).alias("base"), "seq")
    return first_by(wanted.join(there, "base"), ["path"], [F.col("seq"), F.col("test_path")]).select("path", "test_path")
