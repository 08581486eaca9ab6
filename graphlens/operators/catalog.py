"""Service catalogue: dependencies, drift, owners, languages, frameworks, endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import detect_language
from ..schemas import FRAMEWORKS
from ..sources.shared import materialize
from .graph import cross_repo_edges


def dependency_map(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """repo, direction (out or in), other, kind, cnt of cross-repository edges."""
    e = cross_repo_edges(nodes, edges)
    out = e.groupBy(F.col("source_repo").alias("repo"), F.col("target_repo").alias("other"), "kind").agg(F.count("*").alias("cnt")).withColumn("direction", F.lit("out"))
    out = materialize(out)  # a row for each pair of repositories and kind
    into = out.select(F.col("other").alias("repo"), F.col("repo").alias("other"), "kind", "cnt", F.lit("in").alias("direction"))
    return out.unionByName(into)


def evidence(nodes: DataFrame, edges: DataFrame, limit: int = 5) -> DataFrame:
    """Up to `limit` edges of each dependency, the first inserted."""
    e = cross_repo_edges(nodes, edges).withColumn("rn", F.row_number().over(Window.partitionBy("source_repo", "target_repo", "kind").orderBy("seq", "source", "target")))
    return e.where(F.col("rn") <= limit).select("source_repo", "target_repo", "kind", "source", "target")


def drift(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """declared(name) against actual(name): name, status (ok, missing, undeclared)."""
    d, a = declared.select("name").distinct().withColumn("d", F.lit(1)), actual.select("name").distinct().withColumn("a", F.lit(1))
    status = F.when(F.col("a").isNull(), "missing").when(F.col("d").isNull(), "undeclared").otherwise("ok")
    return d.join(a, "name", "full_outer").select("name", status.alias("status"))


def drift_score(found: DataFrame) -> DataFrame:
    return found.agg((F.count_if(F.col("status") != "ok") / F.greatest(F.count("*"), F.lit(1))).alias("score"))


def owners(commits: DataFrame, last: int = 200) -> DataFrame:
    """commits(repo, author, committed_at, hash): the most frequent author of a repository's last commits; ties to the least name."""
    recent = commits.withColumn("rn", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("committed_at"), F.desc("hash")))).where(F.col("rn") <= last)
    n = recent.groupBy("repo", "author").agg(F.count("*").alias("n"))
    return n.groupBy("repo").agg(F.min_by("author", F.struct(-F.col("n"), "author")).alias("author"), F.max("n").alias("commits")).select("repo", F.concat(F.lit("user:"), F.col("author")).alias("owner"), "commits")


def every_owner(repos: DataFrame, commits: DataFrame, last: int = 200) -> DataFrame:
    """repos(repo) -> repo, owner; `unknown` for a repository without commits."""
    recent = commits.withColumn("rn", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("committed_at"), F.desc("hash")))).where(F.col("rn") <= last)
    n = recent.groupBy("repo", "author").agg(F.count("*").alias("n")).groupBy("repo").agg(F.min_by("author", F.struct(-F.col("n"), "author")).alias("author"))
    return repos.select("repo").distinct().join(n, "repo", "left").select("repo", F.coalesce(F.concat(F.lit("user:"), F.col("author")), F.lit("unknown")).alias("owner"))


def kinds_by_repository(nodes: DataFrame) -> DataFrame:
    """repo, counts: a map from each node kind to its number."""
    n = nodes.groupBy("repo", "kind").agg(F.count("*").alias("n"))
    return n.groupBy("repo").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("counts"))


def quality_by_repository(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """repo, mean and numbers of good (0.7 and more), moderate (0.4 and more) and poor nodes; the repository's own node counts."""
    q = nodes.select("id", "repo").join(scores.select("id", "quality"), "id")
    good, fair = F.col("quality") >= 0.7, F.col("quality") >= 0.4
    return q.groupBy("repo").agg(F.avg("quality").alias("mean"), F.count_if(good).alias("good"), F.count_if(fair & ~good).alias("moderate"), F.count_if(~fair).alias("poor"))


def index_report(changes: DataFrame) -> DataFrame:
    """changes(repo, status) of an incremental run -> repo, added, modified, deleted, renamed."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return changes.groupBy("repo").agg(n("added"), n("modified"), n("deleted"), n("renamed"))


def languages(files: DataFrame) -> DataFrame:
    return files.withColumn("language", detect_language(F.col("path"))).where("language != ''").groupBy("repo", "language").agg(F.count("*").alias("cnt"))


def frameworks(imports: DataFrame) -> DataFrame:
    """imports(repo, name): framework names whose indicator is inside the lower-cased import."""
    table = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in FRAMEWORKS.items()))
    hit = F.explode(F.filter(table, lambda t: F.contains(F.lower("name"), t["k"])))
    return imports.select("repo", hit.alias("f")).groupBy("repo").agg(F.array_sort(F.collect_set("f.v")).alias("frameworks"))


def top_dependencies(imports: DataFrame, k: int = 10) -> DataFrame:
    """imports(repo, name, seq): the k most frequent names of each repository; ties to the first seen."""
    n = imports.groupBy("repo", "name").agg(F.count("*").alias("cnt"), F.min("seq").alias("seq"))
    return n.withColumn("rn", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("cnt"), "seq", "name"))).where(F.col("rn") <= k).select("repo", "name", "cnt", "rn")


def endpoint(code: Column) -> Column:
    """struct(method, path) of a route decorator; app.route counts as GET."""
    verb = F.regexp_extract(code, "(?i)@\\w+\\.(get|post|put|delete|patch)\\s*\\(\\s*[\"']([^\"']*)", 1)
    path = F.regexp_extract(code, "(?i)@\\w+\\.(get|post|put|delete|patch)\\s*\\(\\s*[\"']([^\"']*)", 2)
    route = F.regexp_extract(code, "(?i)@\\w+\\.route\\s*\\(\\s*[\"']([^\"']*)", 1)
    return F.when(verb != "", F.struct(F.upper(verb).alias("method"), path.alias("path"))).when(route != "", F.struct(F.lit("GET").alias("method"), route.alias("path")))


def service_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per repository: nodes, files, symbols, dependencies out and in."""
    counts = nodes.groupBy("repo").agg(F.count("*").alias("nodes"), F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind").isin("function", "class", "type", "method")).alias("symbols"))
    deps = dependency_map(nodes, edges).groupBy("repo").agg(
        F.count_distinct(F.when(F.col("direction") == "out", F.col("other"))).alias("dependencies"), F.count_distinct(F.when(F.col("direction") == "in", F.col("other"))).alias("dependents"))
    return counts.join(deps, "repo", "left").select("repo", "nodes", "files", "symbols", F.coalesce("dependencies", F.lit(0)).alias("dependencies"), F.coalesce("dependents", F.lit(0)).alias("dependents"))


def entity_name(name: Column) -> Column:
    """A catalogue entity's name: lower case, each run of what is no ASCII letter or digit one hyphen, none at either end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9-]", "-"), "-+", "-"), "^-|-$", "")


def api_name(repo: Column, method: Column, path: Column) -> Column:
    """The name of an endpoint's entity; braces of the path go."""
    inner = F.replace(F.regexp_replace(F.regexp_replace(path, "^/", ""), "[{}]", ""), F.lit("/"), F.lit("-"))
    return entity_name(F.concat_ws("-", repo, F.lower(method), inner))


def catalogue(nodes: DataFrame, edges: DataFrame, imports: DataFrame, quality: DataFrame, owners: DataFrame | None = None, repos: DataFrame | None = None) -> DataFrame:
    """One row for each repository, put together from its parts: repo, node_id, owner, quality, kinds, languages, frameworks,
    top_dependencies, apis, dependencies (with evidence) and dependents.

    imports(repo, name, seq), quality(id, quality) and owners(repo, owner) as their operators give them. With repos(repo) those
    are the rows; one that the graph lacks has an empty entry. The lists hold endpoints and neighbours of one repository.
    """
    rows = (nodes if repos is None else repos).select("repo").where("repo IS NOT NULL").distinct()
    own = nodes.where("kind = 'repository'").groupBy("repo").agg(F.min_by("id", F.struct("seq", "id")).alias("node_id"))
    mean = nodes.select("id", "repo").join(quality.select("id", F.col("quality").alias("score")), "id").groupBy("repo").agg(F.round(F.avg("score"), 3).alias("quality"))
    pairs = lambda df, key, value: df.groupBy("repo").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias("m"))
    kinds = pairs(nodes.groupBy("repo", "kind").agg(F.count("*").alias("cnt")), "kind", "cnt").withColumnRenamed("m", "kinds")
    langs = pairs(languages(nodes.where("kind = 'file'").select("repo", "path")), "language", "cnt").withColumnRenamed("m", "languages")
    top = top_dependencies(imports).groupBy("repo").agg(F.sort_array(F.collect_list(F.struct("rn", "name", "cnt"))).alias("x")).select("repo", F.col("x.name").alias("top_dependencies"))
    api = F.struct(F.col("seq"), F.coalesce("http_method", F.lit("GET")).alias("method"), F.coalesce("route_path", F.lit("")).alias("path"), F.col("id").alias("node_id"), F.col("name").alias("function"))
    apis = nodes.where("kind = 'api_endpoint'").groupBy("repo").agg(F.sort_array(F.collect_list(api)).alias("apis"))
    proof = evidence(nodes, edges).groupBy("source_repo", "target_repo", "kind").agg(F.sort_array(F.collect_list(F.struct("source", "target"))).alias("evidence"))
    links = materialize(dependency_map(nodes, edges))
    out = links.where("direction = 'out'").join(proof, (F.col("repo") == F.col("source_repo")) & (F.col("other") == F.col("target_repo")) & (links["kind"] == proof["kind"]), "left")
    out = out.groupBy("repo").agg(F.sort_array(F.collect_list(F.struct(F.col("other").alias("repo"), links["kind"].alias("type"), "cnt", "evidence"))).alias("dependencies"))
    into = links.where("direction = 'in'").groupBy("repo").agg(F.sort_array(F.collect_set("other")).alias("dependents"))
    parts = [own, mean, kinds, langs, frameworks(imports), top, apis, out, into, *([] if owners is None else [owners.select("repo", "owner")])]
    for part in parts:
        rows = rows.join(part, "repo", "left")
    none = {"kinds": F.create_map().cast("map<string,bigint>"), "languages": F.create_map().cast("map<string,bigint>")}
    lists = {c: F.array().cast(rows.schema[c].dataType) for c in ("frameworks", "top_dependencies", "apis", "dependencies", "dependents")}
    filled = rows.withColumns({c: F.coalesce(c, v) for c, v in (none | lists).items()})
    return filled.withColumns({"owner": F.coalesce(F.col("owner") if owners is not None else F.lit(None).cast("string"), F.lit("unknown")), "quality": F.coalesce("quality", F.lit(0.0))})


def entities(entries: DataFrame) -> DataFrame:
    """kind, name, type, owner, tags, provides, consumes, depends_on, node_id, repo of rows of catalogue().

    A repository is a Component: a service if it has endpoints, else a library; its tags are languages and frameworks, each once.
    An endpoint is an API. References name their kind and the default namespace; calls of another repository's endpoints are
    consumed, other dependencies depended on.
    """
    ref = lambda kind, name: F.concat(F.lit(f"{kind}:default/"), name)
    tags = F.array_distinct(F.concat(F.map_keys("languages"), F.transform("frameworks", entity_name)))
    others = lambda keep: F.transform(F.filter("dependencies", keep), lambda d: ref("component", entity_name(d["repo"])))
    component = entries.select(
        F.lit("Component").alias("kind"), entity_name(F.col("repo")).alias("name"), F.when(F.size("apis") > 0, "service").otherwise("library").alias("type"), "owner", tags.alias("tags"),
        F.transform("apis", lambda a: ref("api", api_name(F.col("repo"), a["method"], a["path"]))).alias("provides"), others(lambda d: d["type"] == "api_calls").alias("consumes"),
        others(lambda d: d["type"] != "api_calls").alias("depends_on"), "node_id", "repo",
    )
    none = F.array().cast("array<string>")
    api = entries.select("repo", "owner", F.explode("apis").alias("a")).select(
        F.lit("API").alias("kind"), api_name(F.col("repo"), F.col("a.method"), F.col("a.path")).alias("name"), F.lit("openapi").alias("type"), "owner", none.alias("tags"), none.alias("provides"), none.alias("consumes"),
        none.alias("depends_on"), F.col("a.node_id").alias("node_id"), "repo",
    )
    return component.unionByName(api)
