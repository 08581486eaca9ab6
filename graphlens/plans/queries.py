"""Registered queries over the star schema and the corpus, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import any_glob, map_to_json, detect_language, identifiers, node_class, normalize_route, path_suffix_match, recency, rounded, saturate, split_name, symbol_kind, token_estimate
from ..operators import catalog, changeset, graph, guardrails, link, quality, reports, sessions, summaries, temporal, text, text_index, vector, vector_index
from ..schemas import CLASS_HINTS, DECLARATION_ENDS, EDGE_WEIGHTS, EXTENSIONS, FRAMEWORKS, FUNCTION_HINTS, INTENTS, KEYWORDS, NO_SYMBOLS, STOPWORDS, SYMBOL_KINDS, THIN_CLASS
from ..sources import parse
from ..sources.shared import materialize, shared_dir
from ..sources.snapshots import Store
from ..streaming import changes, stateful
from . import index
from .adapters import SQL_EDGES, SQL_GRAPH, SQL_NODES, edges, nodes, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _nodes(spark, d) -> DataFrame:
    """The star schema's nodes, written once: a query reads them several times."""
    return materialize(nodes(spark, d))


def _edges(spark, d) -> DataFrame:
    return materialize(edges(spark, d))


def _r(column: str, digits: int = 6):
    return F.round(F.col(column), digits).alias(column)


# -- time -------------------------------------------------------------------

_PART_HISTORY = "h AS (SELECT l_partkey AS id, count(*) AS n, max(l_shipdate) AS m FROM lineitem GROUP BY 1), t AS (SELECT max(l_shipdate) AS now FROM lineitem)"
_RECENCY = "exp(-0.02::DOUBLE * greatest(0, floor((epoch_us(now) - epoch_us(m)) / 86400000000.0)))"


def _history(spark, d) -> DataFrame:
    line = table(spark, d, "lineitem").select("l_partkey", F.col("l_shipdate").cast("timestamp").alias("at"))
    now = line.agg(F.max("at").alias("now"))
    return line.groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("modification_count"), F.max("at").alias("last_modified")).crossJoin(F.broadcast(now))


@query(f"WITH {_PART_HISTORY} SELECT id, n AS modification_count, round(0.6::DOUBLE * (1 - 1 / (1 + n / 10.0::DOUBLE)) + 0.4::DOUBLE * {_RECENCY}, 6) AS score FROM h, t ORDER BY 0.6::DOUBLE * (1 - 1 / (1 + n / 10.0::DOUBLE)) + 0.4::DOUBLE * {_RECENCY} DESC, id LIMIT 20")
def hotspots_topk(spark, d):
    return temporal.hotspots(_history(spark, d), F.col("now")).select("id", "modification_count", _r("score"))


@query(f"""WITH {_PART_HISTORY} SELECT id, round(0.45::DOUBLE * (id % 10) / 10 + 0.18::DOUBLE * {_RECENCY} + 0.12::DOUBLE * (1 - 1 / (1 + n / 10.0::DOUBLE)) + 0.12::DOUBLE * CASE WHEN id % 7 > 0 THEN 1 - 1 / (1 + (id % 7) / 10.0::DOUBLE) ELSE 0 END + 0.13::DOUBLE * (id % 3) / 3, 6) AS final FROM h, t""")
def temporal_rerank(spark, d):
    h = _history(spark, d).withColumns({"score": (F.col("id") % 10) / 10, "co_retrieved": F.col("id") % 7, "quality": (F.col("id") % 3) / 3})
    return temporal.rerank(h, F.col("now")).select("id", _r("final"))


@query("WITH l AS (SELECT DISTINCT l_orderkey AS r, l_suppkey AS id FROM lineitem) SELECT a.id, b.id AS other_id, count(*) AS cnt FROM l a JOIN l b ON a.r = b.r AND a.id <> b.id GROUP BY ALL")
def co_retrieval(spark, d):
    return temporal.co_retrieval(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("retrieval_id"), F.col("l_suppkey").alias("id")).distinct())


@query("SELECT o_custkey AS path, max(o_orderdate)::VARCHAR AS last_modified, least(count(*), 50) AS modification_count FROM orders GROUP BY 1")
def file_history(spark, d):
    c = table(spark, d, "orders").select(F.lit("r").alias("repo"), F.col("o_custkey").alias("path"), F.col("o_orderdate").cast("timestamp").alias("committed_at"))
    return temporal.file_history(c).select("path", F.date_format("last_modified", "yyyy-MM-dd HH:mm:ss").alias("last_modified"), F.col("modification_count").cast("long"))


# -- graph ------------------------------------------------------------------


@query(f"WITH {SQL_GRAPH} SELECT 'kind' AS what, kind AS key, count(*) AS cnt FROM nodes GROUP BY kind UNION ALL SELECT 'repo', repo, count(*) FROM nodes GROUP BY repo UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY kind")
def graph_stats(spark, d):
    return graph.stats(nodes(spark, d), edges(spark, d))


_CROSS = "x AS (SELECT e.*, a.repo AS source_repo, b.repo AS target_repo FROM edges e JOIN nodes a ON e.source = a.id JOIN nodes b ON e.target = b.id WHERE a.repo <> b.repo OR e.kind IN ('api_calls','shared_lib','proto_defines'))"


@query(f"WITH {SQL_GRAPH}, {_CROSS} SELECT source_repo, target_repo, kind, count(*) AS cnt FROM x GROUP BY ALL")
def cross_repo_edges(spark, d):
    return graph.cross_repo_edges(_nodes(spark, d).select("id", "repo"), edges(spark, d)).groupBy("source_repo", "target_repo", "kind").agg(F.count("*").alias("cnt"))


_COUPLING = """dep AS (SELECT * FROM edges WHERE kind <> 'contains'),
ce AS (SELECT source AS id, count(*) AS ce FROM dep GROUP BY 1), ca AS (SELECT target AS id, count(*) AS ca FROM dep GROUP BY 1),
cpl AS (SELECT id, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce, CASE WHEN coalesce(ca, 0) + coalesce(ce, 0) > 0 THEN coalesce(ce, 0)::DOUBLE / (coalesce(ca, 0) + coalesce(ce, 0)) ELSE 0 END AS instability FROM nodes LEFT JOIN ce USING (id) LEFT JOIN ca USING (id))"""


@query(f"WITH {SQL_GRAPH}, {_COUPLING} SELECT id, ca, ce, round(instability, 6) AS instability FROM cpl")
def coupling_metrics(spark, d):
    return graph.coupling(nodes(spark, d), edges(spark, d)).select("id", "ca", "ce", _r("instability"))


@query(f"WITH {SQL_EDGES} SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1")
def degree_map(spark, d):
    return graph.degrees(edges(spark, d))


@query(f"WITH RECURSIVE {SQL_EDGES}, t AS (SELECT 'r:' || r_regionkey AS root, 'r:' || r_regionkey AS id, 0 AS depth FROM region UNION ALL SELECT root, e.target, depth + 1 FROM t JOIN edges e ON e.source = t.id AND e.kind = 'contains' WHERE depth < 4) SELECT root, depth, count(*) AS cnt FROM t WHERE depth > 0 GROUP BY ALL")
def contains_closure(spark, d):
    roots = table(spark, d, "region").select(F.concat(F.lit("r:"), F.col("r_regionkey").cast("string")).alias("id"))
    return graph.descendants(edges(spark, d), roots, 4).groupBy("root", "depth").agg(F.count("*").alias("cnt"))


@query(f"""WITH RECURSIVE {SQL_EDGES}, t AS (SELECT 'p:' || p_partkey AS id, 0 AS hop FROM part UNION SELECT e.source, hop + 1 FROM t JOIN edges e ON e.target = t.id AND (e.kind IN ('calls','uses_type','inherits','implements') OR (e.kind = 'imports' AND hop >= 1)) WHERE hop < 3)
SELECT id, min(hop) AS hop FROM t GROUP BY id HAVING min(hop) > 0""")
def impact_hops(spark, d):
    targets = table(spark, d, "part").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id"))
    return graph.impact(_edges(spark, d), targets, 3)


@query(f"WITH RECURSIVE {SQL_EDGES}, t AS (SELECT 'c:' || c_custkey AS id, 0 AS hop FROM customer UNION SELECT e.target, hop + 1 FROM t JOIN edges e ON e.source = t.id WHERE hop < 4) SELECT id, min(hop) AS hop FROM t GROUP BY id")
def shortest_path_len(spark, d):
    sources = table(spark, d, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("id"))
    return graph.distances(_edges(spark, d), sources, 4)


_NEW = "fresh AS (SELECT DISTINCT 'p:' || l_partkey AS source, 'c:' || o_custkey AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _new_edges(spark, d) -> DataFrame:
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    pairs = line.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_partkey", "o_custkey").distinct()
    ident = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return pairs.select(ident("p:", "l_partkey").alias("source"), ident("c:", "o_custkey").alias("target"), F.lit("imports").alias("kind"))


@query(f"""WITH {SQL_EDGES}, {_NEW}, every AS (SELECT source, target FROM edges WHERE kind IN ('imports','calls') UNION SELECT source, target FROM fresh)
SELECT a.source AS part, count(*) AS cycles FROM fresh a JOIN every b ON b.source = a.target JOIN every c ON c.source = b.target AND c.target = a.source WHERE b.target <> a.source AND b.target <> a.target GROUP BY 1""")
def cycles_new_edges(spark, d):
    found = graph.new_cycles(edges(spark, d), _new_edges(spark, d), ("imports", "calls"), 3, None)
    return found.withColumn("part", F.filter("cycle", lambda x: x.startswith("p:"))[0]).groupBy("part").agg(F.count("*").alias("cycles"))


@query(f"""WITH {SQL_GRAPH}, seeds AS (SELECT id, 0.9::DOUBLE AS score FROM nodes WHERE kind = 'class'), sim AS (SELECT id, (seq % 10) / 10.0::DOUBLE AS sim FROM nodes WHERE seq % 3 > 0),
w AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in EDGE_WEIGHTS.items())}) v(kind, w)),
both_ends AS (SELECT source AS id, target AS t, kind FROM edges UNION ALL SELECT target, source, kind FROM edges),
h1 AS (SELECT n.id, coalesce(sim, 0.5) * max(w) AS score FROM seeds s JOIN both_ends b ON b.id = s.id JOIN w USING (kind) JOIN nodes n ON n.id = b.t LEFT JOIN sim ON sim.id = n.id WHERE n.id NOT IN (SELECT id FROM seeds) AND (sim IS NULL OR sim >= 0.3) GROUP BY n.id, sim),
f1 AS (SELECT id, score, 0 AS hop FROM seeds UNION ALL SELECT id, score, 1 FROM h1),
h2 AS (SELECT n.id, coalesce(sim, 0.5) * max(w) AS score FROM h1 s JOIN both_ends b ON b.id = s.id JOIN w USING (kind) JOIN nodes n ON n.id = b.t LEFT JOIN sim ON sim.id = n.id WHERE n.id NOT IN (SELECT id FROM f1) AND (sim IS NULL OR sim >= 0.3) GROUP BY n.id, sim)
SELECT id, round(score, 6) AS score, hop FROM f1 UNION ALL SELECT id, round(score, 6), 2 FROM h2""")
def expand_khop(spark, d):
    n = _nodes(spark, d)
    seeds = n.where("kind = 'class'").select("id", F.lit(0.9).alias("score"))
    sim = n.where("seq % 3 > 0").select("id", ((F.col("seq") % 10) / 10).alias("sim"))
    return graph.expand(n, _edges(spark, d), seeds, sim, 2, 0.3).select("id", _r("score"), "hop")


@query(f"WITH {SQL_EDGES} SELECT DISTINCT target AS id, 0.3::DOUBLE AS score FROM edges WHERE kind = 'uses_type' AND source IN (SELECT 'o:' || o_orderkey FROM orders)")
def type_context(spark, d):
    members = table(spark, d, "orders").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("id"))
    return graph.context_of(edges(spark, d), members, "uses_type", 0.3)


@query(f"""WITH {SQL_EDGES}, every AS (SELECT source, target, kind, CASE kind WHEN 'contains' THEN 0 WHEN 'uses_type' THEN 2 ELSE 1 END AS seq FROM edges UNION ALL SELECT source, target, 'shared_lib', 4 FROM edges WHERE kind = 'imports')
SELECT kind, count(*) AS cnt FROM (SELECT source, target, arg_max(kind, seq) AS kind FROM every GROUP BY 1, 2) GROUP BY kind""")
def simple_edges(spark, d):
    e = edges(spark, d)
    shared = e.where("kind = 'imports'").withColumns({"kind": F.lit("shared_lib"), "seq": F.lit(4).cast("long")})
    return graph.simple_edges(e.unionByName(shared)).groupBy("kind").agg(F.count("*").alias("cnt"))


@query(f"WITH {SQL_NODES} SELECT id, kind, name FROM nodes WHERE kind = 'class' ORDER BY seq, id LIMIT 25 OFFSET 10")
def paginate(spark, d):
    return graph.page(nodes(spark, d), 25, 10, kind="class").select("id", "kind", "name")


@query(f"WITH {SQL_GRAPH}, m AS (SELECT id FROM nodes WHERE repo = 'ASIA') SELECT source, target, kind FROM edges WHERE source IN (SELECT id FROM m) AND target IN (SELECT id FROM m)")
def induced_subgraph(spark, d):
    return graph.induced(_edges(spark, d), materialize(nodes(spark, d).where("repo = 'ASIA'").select("id"))).select("source", "target", "kind")


@query(f"WITH {SQL_GRAPH}, gone AS (SELECT id FROM nodes WHERE path LIKE 'ASIA/%' AND kind <> 'module') SELECT kind, count(*) AS cnt FROM edges WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone) GROUP BY 1")
def remove_by_path(spark, d):
    n = nodes(spark, d)
    gone = n.where(F.col("path").startswith("ASIA/") & (F.col("kind") != "module"))
    return graph.remove_nodes(n, edges(spark, d), gone)[1].groupBy("kind").agg(F.count("*").alias("cnt"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE p_name END AS name FROM part UNION ALL SELECT p_partkey + 10000000, 'new' FROM part WHERE p_partkey % 3 = 0")
def upsert_delta(spark, d):
    old = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    some = old.where("id % 3 = 0").withColumn("name", F.lit("new"))
    return graph.insert_nodes(old, some.unionByName(some.withColumn("id", F.col("id") + 10_000_000)))


# -- quality ----------------------------------------------------------------

_THIN = " OR ".join(f"contains(lower(name), '{p}')" for p in THIN_CLASS)
_SYMBOLS = ", ".join(f"'{k}'" for k in SYMBOL_KINDS)
_QUALITY = f"""eo AS (SELECT source AS id, count(*) FILTER (kind <> 'contains') AS mo, count(*) FILTER (kind = 'contains') AS c, list(DISTINCT kind) AS kinds FROM edges GROUP BY 1),
ei AS (SELECT target AS id, count(*) AS mi FROM edges WHERE kind <> 'contains' GROUP BY 1),
q0 AS (SELECT n.*, coalesce(mo, 0) + coalesce(mi, 0) AS m, coalesce(c, 0) AS c, coalesce(kinds, []) AS kinds, kind IN ({_SYMBOLS}) AS sym,
 kind = 'class' AND (({_THIN}) OR end_line - start_line < 15 OR coalesce(length(raw_code) > 0 AND length(raw_code) < 300, false)) AS thin FROM nodes n LEFT JOIN eo USING (id) LEFT JOIN ei USING (id)),
q1 AS (SELECT *, CASE WHEN thin THEN least(1, 0.6 + 0.1 * m) WHEN kind = 'class' THEN 1 - 1 / (1 + (m + c) / 4.0) WHEN sym THEN 1 - 1 / (1 + m / 5.0) WHEN kind = 'file' THEN 1 - 1 / (1 + c / 3.0) ELSE 1 - 1 / (1 + m / 3.0) END::DOUBLE AS density,
 has_embedding::INT::DOUBLE AS embedded, (coalesce(length(raw_code), 0) > 0 OR coalesce(length(summary), 0) > 0)::INT::DOUBLE AS con0,
 CASE WHEN kind = 'file' AND c = 0 THEN [] WHEN kind = 'file' AND c <= 2 THEN ['contains'] WHEN kind = 'file' THEN ['contains', 'imports'] WHEN kind = 'module' THEN ['contains'] ELSE [] END AS expected FROM q0),
q2 AS (SELECT *, CASE WHEN sym THEN 0.7::DOUBLE * con0 + 0.3::DOUBLE * (coalesce(length(docstring), 0) > 0)::INT ELSE con0 END AS content, CASE WHEN len(expected) = 0 THEN 1 ELSE len(list_intersect(expected, kinds))::DOUBLE / len(expected) END::DOUBLE AS coverage,
 CASE WHEN thin THEN [.15, .35, .35, .15]::DOUBLE[] WHEN sym THEN [.4, .25, .2, .15]::DOUBLE[] WHEN kind = 'file' THEN [.25, .2, .25, .3]::DOUBLE[] ELSE [.25, .25, .25, .25]::DOUBLE[] END AS w FROM q1),
q AS (SELECT *, w[1] * density + w[2] * embedded + w[3] * content + w[4] * coverage AS quality FROM q2)"""


def _quality(spark, d) -> DataFrame:
    return quality.scores(nodes(spark, d), edges(spark, d))


@query(f"WITH {SQL_GRAPH}, {_QUALITY} SELECT id, round(quality, 6) AS quality, round(density, 6) AS density, coverage FROM q")
def quality_scores(spark, d):
    return _quality(spark, d).select("id", _r("quality"), _r("density"), "coverage")


@query(f"WITH {SQL_GRAPH}, {_QUALITY} SELECT count(*) AS total, round(avg(quality), 6) AS mean, count(*) FILTER (quality >= 0.7) AS high, count(*) FILTER (quality >= 0.4 AND quality < 0.7) AS medium, count(*) FILTER (quality < 0.4) AS low, count(*) FILTER (quality < 0.4) AS gaps FROM q WHERE kind <> 'repository'")
def quality_bins(spark, d):
    return quality.overview(_quality(spark, d)).withColumn("mean", F.round("mean", 6))


@query(f"""WITH {SQL_GRAPH}, {_QUALITY} SELECT id, kind, round(quality, 6) AS quality, CASE WHEN r = '' THEN 'low overall connectivity' ELSE r END AS reasons FROM (SELECT *, concat_ws('; ',
 CASE WHEN len(list_filter(expected, lambda x: NOT list_contains(kinds, x))) > 0 THEN 'missing edges: ' || array_to_string(list_sort(list_filter(expected, lambda x: NOT list_contains(kinds, x))), ', ') END,
 CASE WHEN embedded = 0 THEN 'no embedding' END, CASE WHEN content < 0.5 THEN 'no code or summary' END, CASE WHEN sym AND m = 0 AND NOT thin THEN 'isolated' END) AS r FROM q WHERE kind <> 'repository' AND quality < 0.4 ORDER BY quality, id LIMIT 50)""")
def quality_gaps(spark, d):
    return quality.gaps(_quality(spark, d)).withColumn("quality", F.round("quality", 6))


# -- vectors ----------------------------------------------------------------

_Q = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1)"
_KIND = "CASE label % 5 WHEN 0 THEN 'repository' WHEN 1 THEN 'module' WHEN 2 THEN 'file' WHEN 3 THEN 'class' ELSE 'function' END"


def _vectors(spark, d) -> DataFrame:
    kind = F.when(F.col("label") % 5 == 0, "repository").when(F.col("label") % 5 == 1, "module").when(F.col("label") % 5 == 2, "file").when(F.col("label") % 5 == 3, "class").otherwise("function")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label", kind.alias("kind"))


def _query_vector(spark, d):
    return vector.literal(table(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0])


@query(f"WITH {_Q} SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id LIMIT 10")
def vec_topk(spark, d):
    return vector.top_k(_vectors(spark, d), _query_vector(spark, d)).select("id", _r("score"))


@query(f"WITH {_Q} SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id LIMIT 10")
def vec_index_topk(spark, d):
    store = Store(spark, shared_dir(spark))
    vector_index.build(store, _vectors(spark, d))
    asked = table(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0]
    return vector_index.search(store.view(), list(asked), exact=True).select("id", _r("score"))


@query(f"WITH {_Q} SELECT vec_id AS id, round((1 + list_cosine_similarity(embedding::DOUBLE[], q)) / 2, 6) AS score FROM embeddings, q WHERE label = 3 ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id LIMIT 10")
def vec_topk_filtered(spark, d):
    return vector.top_k(_vectors(spark, d), _query_vector(spark, d), where={"label": 3}, unit=True).select("id", _r("score"))


@query(f"""WITH {_Q}, s AS (SELECT vec_id AS id, {_KIND} AS kind, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, q),
a AS (SELECT * FROM s WHERE kind IN ('repository','module','file') QUALIFY row_number() OVER (PARTITION BY kind ORDER BY score DESC, id) <= 3), b AS (SELECT * FROM (SELECT * FROM s ORDER BY score DESC, id LIMIT 9) WHERE kind IN ('class','function'))
SELECT id, kind, round(score, 6) AS score FROM (SELECT * FROM a UNION SELECT * FROM b) ORDER BY score DESC, id LIMIT 9""")
def beam_levels(spark, d):
    return vector.beam(_vectors(spark, d), _query_vector(spark, d), SYMBOL_KINDS).select("id", "kind", _r("score"))


# -- text -------------------------------------------------------------------

_ASK = "where the thorin nter of"


def _split_sql(x: str) -> str:
    return f"list_distinct(list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace({x}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[^a-zA-Z0-9]+'), lambda y: length(y) > 1), lambda y: lower(y)))"


def _tokens_sql(x: str) -> str:
    return f"flatten(list_transform(regexp_extract_all({x}, '[a-zA-Z_][a-zA-Z0-9_]{{2,}}'), lambda w: list_concat([lower(w)], {_split_sql('w')})))"


_BM25 = f"""terms AS (SELECT doc_id AS id, {_tokens_sql("text")} AS t FROM documents), tt AS (SELECT * FROM terms WHERE len(t) > 0), st AS (SELECT count(*) AS n, avg(len(t)) AS avg FROM tt),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM tt) GROUP BY 1), idf AS (SELECT term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf FROM df, st), mi AS (SELECT avg(idf) AS mean FROM idf),
ask AS (SELECT term, count(*) AS qn FROM (SELECT unnest({_tokens_sql(f"'{_ASK}'")}) AS term) GROUP BY 1), wt AS (SELECT term, qn, CASE WHEN idf < 0 THEN 0.25 * mean ELSE idf END AS idf FROM idf JOIN ask USING (term), mi),
po AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM tt) WHERE term IN (SELECT term FROM ask) GROUP BY ALL),
sc AS (SELECT id, sum(qn * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avg))) AS raw FROM po JOIN wt USING (term), st GROUP BY id),
bm AS (SELECT id, CASE WHEN max(raw) OVER () > 0 THEN raw / max(raw) OVER () END AS score, raw FROM (SELECT * FROM sc ORDER BY raw DESC, id LIMIT 9))"""


def _bm25(spark, d) -> DataFrame:
    return text.bm25(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), _ASK)


@query(f"WITH {_BM25} SELECT id, round(score, 6) AS score FROM bm WHERE raw > 0")
def bm25_topk(spark, d):
    return _bm25(spark, d).select("id", _r("score"))


#: Documents of one language go, those of another change.
_CHANGED = "changed AS (SELECT doc_id::VARCHAR AS doc_id, CASE WHEN lang = 'es' THEN text || ' ' || substr(text, 6) ELSE text END AS text FROM documents WHERE lang IS NULL OR lang <> 'de')"


@query(f"WITH {_CHANGED}, {_BM25.replace('FROM documents', 'FROM changed')} SELECT id, round(score, 6) AS score FROM bm WHERE raw > 0")
def bm25_after_changes(spark, d):
    store, docs = Store(spark, shared_dir(spark)), table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "lang")
    text_index.update(store, docs)
    text_index.update(store, docs.where("lang = 'es'").select("id", F.concat_ws(" ", "text", F.substring("text", 6, 1 << 30)).alias("text")), docs.where("lang = 'de'").select("id"))
    return text_index.search(store.view(), _ASK).select("id", _r("score"))


@query(f"""WITH {_BM25}, {_Q}, v AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], q) AS v FROM embeddings, q ORDER BY v DESC, vec_id LIMIT 200)
SELECT id, round(CASE WHEN k IS NULL THEN v WHEN v IS NULL THEN 0.3::DOUBLE * k ELSE 0.7::DOUBLE * v + 0.3::DOUBLE * k END, 6) AS score FROM v FULL JOIN (SELECT id, score AS k FROM bm WHERE raw > 0) USING (id)""")
def hybrid_blend(spark, d):
    v = vector.top_k(_vectors(spark, d), _query_vector(spark, d), 200).select("id", "score")
    return text.blend(v, _bm25(spark, d), 0.7).select("id", _r("score"))


_WORDS = text.query_words("find Supplier large plated Almond steel burnished")


@query(f"""WITH {SQL_NODES}, h AS (SELECT id, len(list_intersect({_split_sql("name")}, {_WORDS!r})) / {len(_WORDS)}.0::DOUBLE AS hit, lower(coalesce(path, '')) AS p FROM nodes),
s AS (SELECT id, CASE WHEN hit > 0 THEN 0.7::DOUBLE * (0.5 + 0.5 * hit) WHEN {" OR ".join(f"contains(p, '{w}')" for w in _WORDS)} THEN 0.7::DOUBLE * 0.4 END AS score FROM h) SELECT id, round(score, 6) AS score FROM s WHERE score IS NOT NULL ORDER BY s.score DESC, id LIMIT 30""")
def name_match(spark, d):
    return text.name_match(nodes(spark, d), "find Supplier large plated Almond steel burnished").select("id", _r("score"))


_ROUTE = r"""CASE WHEN regexp_replace(P, '/+$', '') = '' THEN '/' ELSE regexp_replace(P, '/+$', '') END""".replace("P", r"regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '')")
_ROUTE = rf"lower(regexp_replace(regexp_replace(regexp_replace({_ROUTE}, '\{{[^}}]+\}}', '{{_}}', 'g'), '/:[A-Za-z_][A-Za-z0-9_]*', '/{{_}}', 'g'), '/[0-9]+', '/{{_}}', 'g'))"


@query(f"SELECT page_id, {_ROUTE} AS route FROM pages")
def route_normalize(spark, d):
    return text.routes(table(spark, d, "pages")).select("page_id", "route")


@query(r"SELECT page_id AS id, CASE page_id % 3 WHEN 0 THEN 1.2 WHEN 1 THEN 0.6 ELSE 1.0 END::DOUBLE AS score FROM pages WHERE lower(regexp_extract(url, '://[^/]*(/[a-z]*)/', 1)) = '/en'")
def route_match(spark, d):
    method = F.when(F.col("page_id") % 3 == 0, "GET").when(F.col("page_id") % 3 == 1, "POST")
    ends = table(spark, d, "pages").select(F.col("page_id").alias("id"), method.alias("http_method"), F.regexp_extract("url", "://[^/]*(/[a-z]*)/", 1).alias("route_path"))
    return text.route_match(ends, "who calls GET /en")


@query("WITH c AS (SELECT conv_id, turn, " + ", ".join("(" + " + ".join("regexp_matches(text, '(?i)" + p + "')::INT" for p in ps) + f") AS {n}" for n, ps in INTENTS.items()) + " FROM conversations) SELECT conv_id, turn, CASE WHEN greatest(locate, trace, write, debug) = 0 THEN 'general' WHEN locate = greatest(locate, trace, write, debug) THEN 'locate' WHEN trace = greatest(locate, trace, write, debug) THEN 'trace' WHEN write = greatest(locate, trace, write, debug) THEN 'write' ELSE 'debug' END AS intent FROM c")
def intent_classify(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.intent(F.col("text")).alias("intent"))


_KEYS = ", ".join(f"'{k}'" for k in KEYWORDS)
_IDS = f"list_filter(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_]+')), lambda x: length(x) > 1 AND regexp_matches(x, '^[A-Za-z_]') AND x NOT IN ({_KEYS}))"


@query(f"SELECT doc_id, len({_IDS}) AS n, list_min({_IDS}) AS first FROM documents")
def ident_extract(spark, d):
    ids = identifiers(F.col("text"), KEYWORDS)
    return table(spark, d, "documents").select("doc_id", ids.alias("ids")).select("doc_id", F.size("ids").cast("long").alias("n"), F.array_min("ids").alias("first"))


@query(f"""WITH s AS (SELECT doc_id AS id, regexp_extract(text, '[A-Za-z]{{4,}}', 0) AS name, CASE WHEN doc_id % 2 = 0 THEN 'class' ELSE 'function' END AS kind, text FROM documents WHERE text <> ''),
few AS (SELECT name FROM s GROUP BY 1 HAVING count(*) <= 20), i AS (SELECT id AS source, name AS own, unnest({_IDS}) AS name FROM s)
SELECT source, t.id AS target, CASE WHEN t.kind = 'class' THEN 'uses_type' ELSE 'calls' END AS kind FROM i JOIN s t USING (name) JOIN few USING (name) WHERE name <> own AND source <> t.id GROUP BY ALL""")
def crossfile_link(spark, d):
    docs = table(spark, d, "documents").where("text != ''")
    s = docs.select(F.col("doc_id").alias("id"), F.regexp_extract("text", "[A-Za-z]{4,}", 0).alias("name"), F.when(F.col("doc_id") % 2 == 0, "class").otherwise("function").alias("kind"), F.col("text").alias("raw_code"), F.lit("").alias("signature"))
    return link.link_names(s)


@query(f"""WITH {_CHANGED.replace("text || ' ' || substr(text, 6)", "substr(text, 6)")}, s AS (SELECT doc_id AS id, regexp_extract(text, '[A-Za-z]{{4,}}', 0) AS name, CASE WHEN doc_id::BIGINT % 2 = 0 THEN 'class' ELSE 'function' END AS kind, text FROM changed WHERE text <> ''),
few AS (SELECT name FROM s GROUP BY 1 HAVING count(*) <= 20), i AS (SELECT id AS source, name AS own, unnest({_IDS}) AS name FROM s)
SELECT source, t.id AS target, CASE WHEN t.kind = 'class' THEN 'uses_type' ELSE 'calls' END AS kind FROM i JOIN s t USING (name) JOIN few USING (name) WHERE name <> own AND source <> t.id GROUP BY ALL""")
def links_after_changes(spark, d):
    docs, store = table(spark, d, "documents").where("text != ''"), Store(spark, shared_dir(spark))
    kind = F.when(F.col("doc_id") % 2 == 0, "class").otherwise("function")

    def symbols(rows: DataFrame, code) -> DataFrame:
        own = {"id": F.col("doc_id").cast("string"), "repo": F.col("source"), "kind": kind, "name": F.regexp_extract(code, "[A-Za-z]{4,}", 0), "path": F.concat_ws("/", "source", "doc_id"), "raw_code": code, "signature": F.lit(""), "seq": F.col("doc_id")}
        return rows.where(code != "").select(*(own.get(n, F.lit(None)).cast(t).alias(n) for n, t in (c.split() for c in index.NODE.split(", "))))

    first = materialize(symbols(docs, F.col("text")))
    index.adopt(store, index.Graph(first, link.link_names(first)))
    changed = materialize(symbols(docs.where("lang = 'es'"), F.substring("text", 6, 1 << 30)))
    gone = first.join(docs.where("lang IN ('de', 'es')").select(F.col("doc_id").cast("string").alias("id")), "id", "left_semi").select("repo", "path")
    view = store.view()
    return index.relinked(view, first.join(gone, ["repo", "path"], "left_anti"), changed, gone)[0].where("kind != 'api_calls'")


@query(f"WITH {SQL_NODES}, t AS (SELECT id, greatest(1, floor(length(coalesce(nullif(raw_code, ''), nullif(summary, ''), '')) / 4)) + 15 AS tokens FROM nodes) SELECT id, tokens::BIGINT AS tokens FROM t")
def token_estimates(spark, d):
    from ..functions.expressions import token_text

    return nodes(spark, d).select("id", token_estimate(token_text(F.col("raw_code"), F.col("summary"))).cast("long").alias("tokens"))


# -- search assembly --------------------------------------------------------


@query("""WITH t AS (SELECT doc_id AS id, doc_id % 97 AS score, greatest(1, floor(length(text) / 4)) + 15 AS tokens FROM documents), c AS (SELECT *, sum(tokens) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER (ORDER BY score DESC, id) AS rn FROM t)
SELECT id, cum::BIGINT AS cum FROM c WHERE cum <= 6000 OR rn = 1""")
def budget_prefix(spark, d):
    from .search import budget_prefix as prefix

    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 97).alias("score"), token_estimate(F.col("text")).alias("tokens"))
    return prefix(t, 8000).select("id", F.col("cum").cast("long").alias("cum"))


@query(f"""WITH {SQL_GRAPH}, m AS (SELECT id, kind, (seq % 13)::DOUBLE AS score, seq FROM nodes), tg AS (SELECT DISTINCT target AS id FROM edges WHERE source IN (SELECT id FROM m) AND target IN (SELECT id FROM m)),
b AS (SELECT m.*, CASE WHEN kind = 'type' THEN 0 WHEN kind IN ('config', 'constant') THEN 1 WHEN tg.id IS NOT NULL THEN 2 ELSE 3 END AS bucket FROM m LEFT JOIN tg USING (id)) SELECT id, bucket, row_number() OVER (ORDER BY bucket, score DESC, seq, id) - 1 AS ord FROM b""")
def order_buckets(spark, d):
    from .search import ordered

    m = nodes(spark, d).select("id", "kind", (F.col("seq") % 13).cast("double").alias("score"), "seq")
    return ordered(m, graph.induced(edges(spark, d), m)).select("id", "bucket", F.col("ord").cast("long"))


@query()
def budget_fit(spark, d):
    """No SQL: greedy with a state; held against a brute-force version in the tests."""
    from .search import fit_budgets

    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    items = line.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("string").alias("id"), (F.col("l_quantity") / 50).alias("score"), F.lit(False).alias("is_seed"), F.floor(F.col("l_extendedprice") / 50).cast("long").alias("tokens"), F.lit(20).cast("long").alias("summary_tokens"), (F.col("l_linenumber") % 2 == 0).alias("has_summary"), F.array().cast("array<string>").alias("targets"))
    return fit_budgets(items, 2000)


@query()
def search_bundle(spark, d):
    """No SQL: the whole search; its steps have SQL of their own."""
    from .search import search

    v = _vectors(spark, d).select(F.concat(F.lit("s:"), (F.col("id") + 1).cast("string")).alias("id"), "embedding")
    n = _nodes(spark, d)
    docs = n.where("kind = 'class' OR kind = 'type'").select("id", F.coalesce("raw_code", "summary", "name").alias("text"))
    found = search(n, _edges(spark, d), v, docs, "where is Supplier 7 defined", _query_vector(spark, d))
    return found.select("id", _r("score"), "ord", "summarised")


# -- catalogue --------------------------------------------------------------


@query(f"WITH {SQL_GRAPH}, {_CROSS}, o AS (SELECT source_repo AS repo, target_repo AS other, kind, count(*) AS cnt, 'out' AS direction FROM x GROUP BY ALL) SELECT * FROM o UNION ALL SELECT other, repo, kind, cnt, 'in' FROM o")
def dep_map(spark, d):
    return catalog.dependency_map(_nodes(spark, d), edges(spark, d))


@query(f"WITH {SQL_GRAPH}, {_CROSS}, a AS (SELECT DISTINCT target_repo AS name FROM x WHERE source_repo = 'ASIA'), dc AS (SELECT * FROM (VALUES ('AFRICA'), ('EUROPE'), ('ATLANTIS')) v(name)) SELECT name, CASE WHEN a.name IS NULL THEN 'missing' WHEN dc.name IS NULL THEN 'undeclared' ELSE 'ok' END AS status FROM dc FULL JOIN a USING (name)")
def drift_full_outer(spark, d):
    actual = graph.cross_repo_edges(_nodes(spark, d).select("id", "repo"), edges(spark, d)).where("source_repo = 'ASIA'").select(F.col("target_repo").alias("name"))
    return catalog.drift(spark.createDataFrame([("AFRICA",), ("EUROPE",), ("ATLANTIS",)], "name string"), actual)


@query(f"""WITH {SQL_GRAPH}, {_CROSS} SELECT repo, count(*) AS nodes, count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind IN ('function','class','type','method')) AS symbols,
 (SELECT count(DISTINCT target_repo) FROM x WHERE source_repo = n.repo) AS dependencies, (SELECT count(DISTINCT source_repo) FROM x WHERE target_repo = n.repo) AS dependents FROM nodes n GROUP BY repo""")
def catalog_entry(spark, d):
    return catalog.service_rows(_nodes(spark, d), edges(spark, d))


@query("""WITH c AS (SELECT o_custkey % 25 AS repo, o_orderpriority AS author FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey % 25 ORDER BY o_orderdate DESC, o_orderkey DESC) <= 200), n AS (SELECT repo, author, count(*) AS n FROM c GROUP BY ALL)
SELECT repo, 'user:' || author AS owner, n AS commits FROM n QUALIFY row_number() OVER (PARTITION BY repo ORDER BY n DESC, author) = 1""")
def owner_mode(spark, d):
    c = table(spark, d, "orders").select((F.col("o_custkey") % 25).alias("repo"), F.col("o_orderpriority").alias("author"), F.col("o_orderdate").alias("committed_at"), F.col("o_orderkey").alias("hash"))
    return catalog.owners(c)


_EXT = sorted(EXTENSIONS)[:12]
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in EXTENSIONS.items()) + "}"


@query(f"SELECT source AS repo, {_MAP}[e] AS language, count(*) AS cnt FROM (SELECT source, {_EXT!r}[(doc_id % 12 + 1)::INT] AS e FROM documents) GROUP BY ALL")
def lang_hist(spark, d):
    ext = F.element_at(F.array(*map(F.lit, _EXT)), (F.col("doc_id") % 12 + 1).cast("int"))
    return catalog.languages(table(spark, d, "documents").select(F.col("source").alias("repo"), F.concat(F.lit("src/Main"), F.upper(ext)).alias("path")))


@query("""WITH i AS (SELECT l_suppkey % 10 AS repo, p_type AS name, l_orderkey * 10 + l_linenumber AS seq FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT repo, name, count(*) AS cnt, min(seq) AS seq FROM i GROUP BY 1, 2)
SELECT repo, name, cnt, row_number() OVER (PARTITION BY repo ORDER BY cnt DESC, seq, name) AS rn FROM n QUALIFY rn <= 10""")
def top_deps(spark, d):
    line = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return catalog.top_dependencies(line.select((F.col("l_suppkey") % 10).alias("repo"), F.col("p_type").alias("name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")))


_FW = "[" + ", ".join(f"'{k}'" for k in FRAMEWORKS) + "]"


@query(f"WITH i AS (SELECT lang AS repo, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS name FROM documents) SELECT repo, array_to_string(list_sort(list(DISTINCT {'MAP {' + ', '.join(f'{k!r}: {v!r}' for k, v in FRAMEWORKS.items()) + '}'}[f])), ',') AS frameworks FROM (SELECT repo, unnest(list_filter({_FW}, lambda f: contains(lower(name), f))) AS f FROM i) GROUP BY repo")
def framework_set(spark, d):
    i = table(spark, d, "documents").select(F.col("lang").alias("repo"), F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("name")).distinct()
    return catalog.frameworks(i).withColumn("frameworks", F.array_join("frameworks", ","))


@query(r"SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'GET' ELSE upper(['get', 'post'][doc_id % 2 + 1]) END AS method, '/' || source || '/{id}' AS path FROM documents WHERE doc_id % 5 > 0")
def endpoint_parse(spark, d):
    verb = F.when(F.col("doc_id") % 3 == 2, "route").when(F.col("doc_id") % 2 == 0, "get").otherwise("post")
    code = F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("@app."), verb, F.lit('("/'), F.col("source"), F.lit('/{id}")\ndef handler(): pass'))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", catalog.endpoint(code).alias("e")).where("e IS NOT NULL").select("doc_id", "e.method", "e.path")


# -- rules ------------------------------------------------------------------


@query(f"WITH {SQL_NODES} SELECT id, CASE WHEN regexp_matches(path, '(?s)^.*/CHINA/.*$') OR regexp_matches(path, '(?s)^parts/Brand#1..*$') THEN false ELSE regexp_matches(path, '(?s)^ASIA/.*$') OR regexp_matches(path, '(?s)^parts/.*$') END AS allowed FROM nodes WHERE path IS NOT NULL")
def glob_policy(spark, d):
    n = nodes(spark, d).where("path IS NOT NULL")
    return n.select("id", guardrails.may_access(F.col("path"), ("ASIA/**", "parts/*"), ("*/CHINA/*", "parts/Brand#1?*")).alias("allowed"))


@query(f"WITH {SQL_GRAPH} SELECT e.source, e.target, e.kind FROM edges e JOIN nodes a ON e.source = a.id JOIN nodes b ON e.target = b.id WHERE e.kind = 'imports' AND regexp_matches(a.path, '(?s)^ASIA/.*$') AND regexp_matches(b.path, '(?s)^EUROPE/.*$')")
def dep_ban(spark, d):
    return guardrails.dependency_ban(nodes(spark, d), edges(spark, d), "ASIA/*", "EUROPE/*", kinds=("imports",)).select("source", "target", "kind")


@query(f"WITH {SQL_GRAPH}, {_COUPLING} SELECT id, ca::DOUBLE AS value FROM cpl WHERE id LIKE 's:%' AND ca > 50")
def metric_rule(spark, d):
    n = nodes(spark, d)
    return guardrails.metric_threshold(n, edges(spark, d), n.where("kind = 'class'"), "afferent_coupling", 50)


@query(f"""WITH RECURSIVE {SQL_EDGES}, t AS (SELECT 's:' || s_suppkey AS root, 's:' || s_suppkey AS id, 0 AS hop FROM supplier UNION SELECT root, e.source, hop + 1 FROM t JOIN edges e ON e.target = t.id AND (e.kind IN ('calls','uses_type','inherits','implements') OR (e.kind = 'imports' AND hop >= 1)) WHERE hop < 2)
SELECT root AS id, count(DISTINCT id) AS total FROM t WHERE id <> root GROUP BY 1 HAVING count(DISTINCT id) > 10""")
def impact_rule(spark, d):
    n = _nodes(spark, d)
    return guardrails.impact_threshold(n, _edges(spark, d), n.where("kind = 'class'"), 10, 2)


@query(f"WITH {SQL_NODES} SELECT DISTINCT path FROM nodes WHERE kind = 'file' AND regexp_matches(path, '(?s)^AMERICA/.*[05]$')")
def file_scope_rule(spark, d):
    return guardrails.file_scope_ban(nodes(spark, d).where("kind = 'file'"), "AMERICA/*[05]")


@query("""WITH v AS (SELECT 'rule' || o_custkey % 7 AS rule_id, CASE o_orderkey % 3 WHEN 0 THEN 'block' WHEN 1 THEN 'warning' ELSE 'info' END AS severity FROM orders), p AS (SELECT *, severity = 'block' AND rule_id NOT IN ('rule1', 'rule2') AS pending FROM v)
SELECT count(*) AS total, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'block') AS blocks, count(*) FILTER (pending) AS pending, count(*) FILTER (pending) = 0 AS passed FROM p""")
def verdict_counts(spark, d):
    v = table(spark, d, "orders").select(F.concat(F.lit("rule"), (F.col("o_custkey") % 7).cast("string")).alias("rule_id"), F.when(F.col("o_orderkey") % 3 == 0, "block").when(F.col("o_orderkey") % 3 == 1, "warning").otherwise("info").alias("severity"))
    return guardrails.verdict(guardrails.approve(v, F.array(F.lit("rule1"), F.lit("rule2"))))


@query("SELECT o_orderkey AS id, 'r' || o_custkey % 5 || CASE WHEN o_custkey % 5 = 9 THEN '' ELSE ',z' END AS rule_ids, o_orderpriority AS reason FROM orders")
def approval_trailers(spark, d):
    message = F.concat(F.lit("Change\n\napproved-rules: z, r"), (F.col("o_custkey") % 5).cast("string"), F.lit(",,\nApproved-Reason: first\nAPPROVED-REASON: "), F.col("o_orderpriority"), F.lit("\nApproved-Reason:  \n"))
    return guardrails.approvals(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), message.alias("message"))).withColumn("rule_ids", F.array_join("rule_ids", ","))


@query("WITH n AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS path, l_suppkey % 900 AS a, l_suppkey % 900 + l_quantity::BIGINT AS b FROM lineitem), h AS (SELECT p_partkey AS path, p_size * 10 AS a, p_size * 10 + 12 AS b FROM part WHERE p_partkey % 2 = 0) SELECT DISTINCT id FROM n JOIN h ON n.path = h.path AND n.a <= h.b AND n.b >= h.a")
def line_overlap(spark, d):
    start = (F.col("l_suppkey") % 900).cast("long")
    n = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("path"), start.alias("start_line"), (start + F.col("l_quantity").cast("long")).alias("end_line"))
    h = table(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("path"), (F.col("p_size") * 10).alias("hunk_start"), (F.col("p_size") * 10 + 12).alias("hunk_end"))
    return guardrails.lines_overlap(n, h)


@query(f"WITH {SQL_NODES}, f AS (SELECT path, id FROM nodes WHERE kind = 'file'), c AS (SELECT substr(path, instr(path, '/') + 1) AS file FROM f WHERE seq_ok) SELECT 1".replace("SELECT 1", "SELECT count(*) AS cnt FROM f JOIN c ON f.path = c.file OR ends_with(f.path, '/' || c.file) OR ends_with(c.file, '/' || f.path)").replace("WHERE seq_ok", "WHERE hash_ok").replace("hash_ok", "id LIKE '%7'"))
def path_suffixes(spark, d):
    f = materialize(nodes(spark, d).where("kind = 'file'").select("path", "id"))
    c = f.where("id LIKE '%7'").select(F.expr("substr(path, instr(path, '/') + 1)").alias("file"))
    return changeset.suffix_pairs(f, c).join(f, "path").join(c, "file").agg(F.count("*").alias("cnt"))


@query("WITH s AS (SELECT p_partkey AS seq, p_brand || '::' || p_type AS base, row_number() OVER (PARTITION BY p_brand || '::' || p_type ORDER BY p_partkey) AS rn FROM part) SELECT seq, CASE WHEN rn > 1 THEN base || '_' || rn ELSE base END AS id FROM s")
def seq_suffix_ids(spark, d):
    from ..sources.parse import unique_ids

    return unique_ids(table(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.concat("p_brand", F.lit("::"), "p_type").alias("base"))).select("seq", "id")


@query("""WITH f AS (SELECT c_custkey AS seq, 'src/' || c_mktsegment || '/M' || c_custkey || ['.py', '.ts', '.go', '.java', '.rs', '.c'][(c_custkey % 6 + 1)::INT] AS path, c_custkey FROM customer),
t AS (SELECT c_custkey AS seq, 'tests/' || CASE c_custkey % 6 WHEN 0 THEN 'test_M' || c_custkey || '.py' WHEN 1 THEN 'M' || c_custkey || '.spec.ts' WHEN 2 THEN 'M' || c_custkey || '_test.go' WHEN 3 THEN 'M' || c_custkey || 'Test.java' WHEN 4 THEN 'M' || c_custkey || '_test.rs' ELSE 'M' || c_custkey || '_test.c' END AS test_path FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0)
SELECT path, test_path FROM f JOIN t USING (seq) WHERE seq % 6 <> 4""")
def test_file_match(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    ext = F.element_at(F.array(*map(F.lit, (".py", ".ts", ".go", ".java", ".rs", ".c"))), (k % 6 + 1).cast("int"))
    stem = F.concat(F.lit("M"), k.cast("string"))
    files = c.select(F.concat(F.lit("src/"), "c_mktsegment", F.lit("/"), stem, ext).alias("path"))
    name = F.when(k % 6 == 0, F.concat(F.lit("test_"), stem, ext)).when(k % 6 == 1, F.concat(stem, F.lit(".spec.ts"))).when(k % 6 == 3, F.concat(stem, F.lit("Test.java"))).otherwise(F.concat(stem, F.lit("_test"), ext))
    tests = c.where((k % 2 == 0) | (k % 3 == 0)).select(F.concat(F.lit("tests/"), name).alias("path"), k.alias("seq"))
    return link.test_files(files, tests)


test_file_match.__test__ = False


@query(r"""WITH e AS (SELECT page_id, url FROM pages), c AS (SELECT page_id AS source, regexp_replace(url, '\?.*$', '') AS url FROM pages), n AS (SELECT page_id, url, R AS route FROM e),
t AS (SELECT route, arg_max(page_id, page_id) AS target FROM (SELECT page_id, R AS route FROM (SELECT page_id, url FROM e WHERE page_id % 3 = 0)) GROUP BY 1)
SELECT source, target, url FROM (SELECT source, url, R AS route FROM c WHERE source % 3 > 0) JOIN t USING (route) WHERE source % 2 <> target % 2""".replace("R AS route", f"{_ROUTE} AS route"))
def api_contracts(spark, d):
    p, url = table(spark, d, "pages"), F.regexp_replace("url", "\\?.*$", "")
    callers = p.where("page_id % 3 > 0").select(F.col("page_id").alias("id"), (F.col("page_id") % 2).alias("repo"), F.when(F.col("page_id") % 3 == 1, F.concat(F.lit("fetch('"), url, F.lit("')"))).otherwise(F.concat(F.lit('requests.post(BASE + "'), url, F.lit('", x)'))).alias("raw_code"))
    ends = p.where("page_id % 3 = 0").select(F.col("page_id").alias("id"), (F.col("page_id") % 2).alias("repo"), F.col("url").alias("route_path"), F.col("page_id").alias("seq"))
    return link.api_contracts(callers, ends)


@query("SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'Base' || s_nationkey || ',Mixin' WHEN 1 THEN 'Codable,Proto' || s_nationkey ELSE 'Iface' || s_nationkey || ',Parent' END AS bases FROM supplier")
def inherit_detect(spark, d):
    k, n = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    sig = F.when(k % 3 == 0, F.concat(F.lit("class A(Base"), n, F.lit("[T], Mixin, metaclass=Meta):"))).when(k % 3 == 1, F.concat(F.lit("struct A : Proto"), n, F.lit("<X>, Codable {"))).otherwise(F.concat(F.lit("class A extends Parent implements Iface"), n, F.lit(" {")))
    return table(spark, d, "supplier").select(k.alias("id"), F.array_join(link.bases(sig), ",").alias("bases"))


# -- sessions and changes ---------------------------------------------------


@query("""WITH l AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1) SELECT conv_id, turn, round(least(1, exp(-ln(2::DOUBLE) / 5 * (last - turn))), 6) AS weight,
 CASE WHEN exp(-ln(2::DOUBLE) / 5 * (last - turn)) > 0.8 THEN 'drop' WHEN exp(-ln(2::DOUBLE) / 5 * (last - turn)) > 0.3 THEN 'summary' ELSE 'full' END AS action FROM conversations JOIN l USING (conv_id)""")
def session_decay(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    w = sessions.weight(F.col("last") - F.col("turn"))
    return c.join(last, "conv_id").select("conv_id", "turn", F.round(w, 6).alias("weight"), sessions.action(w).alias("action"))


@query(f"""WITH {_Q}, c AS (SELECT label AS node_id, vec_id AS turn, embedding::DOUBLE[] AS vec FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) = 1), m AS (SELECT max(vec_id) AS now FROM embeddings),
w AS (SELECT node_id, least(1, exp(-ln(2::DOUBLE) / 5 * (now - turn)) + 0.2::DOUBLE * greatest(0, list_cosine_similarity(vec, q))) AS w FROM c, m, q)
SELECT p_partkey AS node_id, CASE WHEN w IS NULL THEN 'full' WHEN w > 0.8 THEN 'drop' WHEN w > 0.3 THEN 'summary' ELSE 'full' END AS action FROM part LEFT JOIN w ON node_id = p_partkey""")
def session_topic_decay(spark, d):
    v = table(spark, d, "embeddings").select(F.col("label").alias("node_id"), F.col("vec_id").alias("turn"), F.col("embedding").alias("vec"))
    now = v.agg(F.max("turn")).first()[0]
    bundle = table(spark, d, "part").select(F.col("p_partkey").alias("node_id"))
    return sessions.dedup(bundle, v, now, question=_query_vector(spark, d)).select("node_id", "action")


@query("SELECT user_id AS session_id, event_id AS node_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 5")
def session_prune(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("node_id"), F.col("ts").alias("turn"))
    return sessions.prune(e, 5).select("session_id", "node_id")


@query("WITH RECURSIVE v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings), t AS (SELECT label, rn, e FROM v WHERE rn = 1 UNION ALL SELECT v.label, v.rn, list_transform(list_zip(v.e, t.e), lambda x: 0.3::DOUBLE * x[1] + 0.7::DOUBLE * x[2]) FROM t JOIN v ON v.label = t.label AND v.rn = t.rn + 1) SELECT label AS session_id, round(e[1], 6) AS first, round(list_sum(e), 6) AS total FROM t QUALIFY row_number() OVER (PARTITION BY label ORDER BY rn DESC) = 1")
def topic_ema(spark, d):
    v = table(spark, d, "embeddings").select(F.col("label").alias("session_id"), F.col("vec_id").alias("turn"), F.col("embedding").alias("vec"))
    total = F.aggregate("topic", F.lit(0.0), lambda a, x: a + x)
    return sessions.topic(v).select("session_id", F.round(F.col("topic")[0], 6).alias("first"), F.round(total, 6).alias("total"))


def _events(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("repo"), F.concat(F.lit("f"), (F.col("event_id") % 9).cast("string")).alias("path"), F.col("event_type").alias("op"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


@query("SELECT user_id AS repo, 'f' || event_id % 9 AS path, arg_max(event_type, epoch_us(ts) * 1000000::HUGEINT + event_id) AS op FROM events GROUP BY ALL")
def last_op_wins(spark, d):
    return changes.last_operations(_events(spark, d)).select("repo", "path", "op")


@query("""WITH e AS (SELECT user_id AS repo, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(new) OVER (PARTITION BY repo ORDER BY ts) AS g FROM e) SELECT repo, min(ts)::VARCHAR AS start, count(*) AS n FROM b GROUP BY repo, g""")
def debounce_batches(spark, d):
    return changes.debounced(_events(spark, d), "1 hour", None).select("repo", F.col("start").cast("string").alias("start"), "n")


@query("""WITH e AS (SELECT user_id AS repo, event_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 7200000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY repo ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS g FROM e), c AS (SELECT *, (us - min(us) OVER (PARTITION BY repo, g)) // 14400000000 AS cut FROM b) SELECT repo, min(us) AS start, count(*) AS n FROM c GROUP BY repo, g, cut""")
def capped_batches(spark, d):
    return changes.batches(_events(spark, d), 7200, 14400).select("repo", F.unix_micros("start").alias("start"), "n")


def _file_events(e: DataFrame) -> DataFrame:
    """Rows of events as changes of files: errors are deletions."""
    op = F.when(F.col("event_type") == "error", "deleted").otherwise("modified")
    return e.select(F.col("user_id").cast("string").alias("repo"), F.concat(F.lit("f"), (F.col("event_id") % 9).cast("string")).alias("path"), op.alias("op"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


_FLUSHES = """WITH e AS (SELECT user_id::VARCHAR AS repo, event_id, 'f' || event_id % 9 AS path, event_type = 'error' AS gone, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 7200000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY repo ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS g FROM e), c AS (SELECT *, (us - min(us) OVER (PARTITION BY repo, g)) // 14400000000 AS cut FROM b),
l AS (SELECT repo, g, cut, path, arg_max(gone, us::HUGEINT * 1000000000 + event_id) AS gone, min(us) AS lo, max(us) AS hi, count(*) AS n FROM c GROUP BY ALL)
SELECT repo, min(lo) AS start, max(hi) AS last, sum(n)::BIGINT AS n, coalesce(string_agg(path, ' ' ORDER BY path) FILTER (NOT gone), '') AS changed, coalesce(string_agg(path, ' ' ORDER BY path) FILTER (gone), '') AS deleted FROM l GROUP BY repo, g, cut"""


def _flush_rows(f: DataFrame) -> DataFrame:
    return f.select("repo", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("last"), "n", F.array_join("changed", " ").alias("changed"), F.array_join("deleted", " ").alias("deleted"))


@query(_FLUSHES)
def flush_batches(spark, d):
    return _flush_rows(stateful.flushes(_file_events(table(spark, d, "events")), 7200, 14400))


@query(_FLUSHES)
def stream_flushes(spark, d):
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table(spark, d, "events").schema)
    return _flush_rows(stateful.flushed(spark, f"{d}/event[s].parquet", schema, _file_events, 7200, 14400, shared_dir(spark)))


# -- changes of a graph, reports --------------------------------------------

_DIFF = """f AS (SELECT c_custkey AS k, path, c_custkey % 500 + 1 AS a, c_custkey % 500 + 1 + c_custkey % 7 + 1 AS b, c_custkey % 10 = 3 AS gone FROM cust),
modified AS (SELECT n.id FROM nodes n JOIN f USING (path) WHERE gone OR (n.start_line <= b AND n.end_line >= a)),
fresh AS (SELECT 'c:' || k AS source, 's:' || (SELECT s_suppkey FROM supplier WHERE s_suppkey = k % 90 + 1) AS target FROM f WHERE NOT gone)"""


def _change(spark, d) -> changeset.ChangeSet:
    """A diff of each customer's file: a few lines at a place by its key with an import of a supplier; some files are deleted."""
    n, k = _nodes(spark, d), F.col("seq")
    place = F.format_string("@@ -1,2 +%d,%d @@\n+import \"s:%d\"\n", k % 500 + 1, k % 7 + 1, k % 90 + 1)
    text = F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\n"), F.when(k % 10 == 3, "deleted file mode 100644\n").otherwise(place))
    return changeset.analyze(n.where("kind = 'file'").select("id", text.alias("diff")), n, _edges(spark, d))


@query(f"WITH {SQL_GRAPH}, {_DIFF} SELECT 'modified' AS what, id AS a, NULL AS b FROM modified UNION ALL SELECT 'imports', source, target FROM fresh UNION ALL SELECT CASE WHEN gone THEN 'deleted' ELSE 'changed' END, path, NULL FROM f")
def change_set(spark, d):
    c = _change(spark, d)
    files = c.files.select(F.when(F.col("status") == "deleted", "deleted").otherwise("changed").alias("what"), F.col("path").alias("a"), F.lit(None).cast("string").alias("b"))
    return c.modified.select(F.lit("modified").alias("what"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b")).unionByName(c.new_edges.select(F.col("kind").alias("what"), F.col("source").alias("a"), F.col("target").alias("b"))).unionByName(files)


_RULES = [
    {"id": "scope", "type": "file_scope_ban", "description": "No changes in Asia", "severity": "block", "config": {"path_pattern": "ASIA/*"}},
    {"id": "ban", "type": "dependency_ban", "description": "Asia does not use Europe", "severity": "block", "config": {"source_pattern": "ASIA/*", "target_pattern": "EUROPE/*", "edge_kind": ["imports"]}},
    {"id": "coupling", "type": "metric_threshold", "description": "Few dependencies", "severity": "warning", "config": {"metric": "efferent_coupling", "threshold": 30}},
    {"id": "broken", "type": "metric_threshold", "description": "Lacks its metric", "severity": "block", "config": {}},
]


@query(f"""WITH {SQL_GRAPH}, {_DIFF}, {_COUPLING}, v AS (SELECT 'scope' AS rule_id, 'block' AS severity, path AS file_path FROM f WHERE path LIKE 'ASIA/%'
UNION ALL SELECT 'ban', 'block', a.path FROM fresh JOIN nodes a ON a.id = source JOIN nodes b ON b.id = target WHERE a.path LIKE 'ASIA/%' AND b.path LIKE 'EUROPE/%'
UNION ALL SELECT 'coupling', 'warning', n.path FROM modified JOIN cpl USING (id) JOIN nodes n USING (id) WHERE ce > 30) SELECT * FROM v""")
def evaluate_change(spark, d):
    n, e = _nodes(spark, d), _edges(spark, d)
    return changeset.evaluate(n, e, _change(spark, d), _RULES).select("rule_id", "severity", "file_path")


@query(f"""WITH {SQL_GRAPH}, up AS (SELECT source, target, kind FROM edges WHERE kind IN ('calls','uses_type','imports')), t AS (SELECT id AS target FROM nodes WHERE kind IN ('type', 'class') AND repo = 'ASIA'),
h1 AS (SELECT t.target, kind, source AS id FROM t JOIN up USING (target) WHERE kind <> 'imports'), h2 AS (SELECT DISTINCT h1.target, up.source AS id FROM (SELECT DISTINCT target, id FROM h1) h1 JOIN up ON up.target = h1.id WHERE up.source <> h1.target AND (h1.target, up.source) NOT IN (SELECT target, id FROM h1)),
c AS (SELECT target, count(*) FILTER (kind = 'calls') AS callers, count(*) FILTER (kind = 'uses_type') AS users FROM h1 GROUP BY 1), l AS (SELECT target, count(*) AS transitive FROM h2 GROUP BY 1)
SELECT target, callers, users, 0 AS implementers, coalesce(transitive, 0) AS transitive, callers + users + coalesce(transitive, 0) AS total FROM c LEFT JOIN l USING (target)""")
def impact_roles(spark, d):
    n = _nodes(spark, d)
    return graph.impact_sizes(n, _edges(spark, d), n.where("kind IN ('type', 'class') AND repo = 'ASIA'"), 2)


@query(f"WITH {SQL_GRAPH}, {_QUALITY} SELECT repo, round(avg(quality), 6) AS mean, count(*) FILTER (quality >= 0.7) AS good, count(*) FILTER (quality >= 0.4 AND quality < 0.7) AS moderate, count(*) FILTER (quality < 0.4) AS poor FROM q GROUP BY repo")
def quality_by_repository(spark, d):
    n = _nodes(spark, d)
    return catalog.quality_by_repository(n, quality.scores(n, _edges(spark, d))).withColumn("mean", F.round("mean", 6))


def _full(n: DataFrame) -> DataFrame:
    empty = F.lit(None).cast("string")
    return n.withColumns({"signature": empty, "http_method": empty, "route_path": empty})


@query(f"""WITH {SQL_GRAPH}, ch AS (SELECT e.source AS of, n.name, n.docstring, n.seq, n.id, row_number() OVER (PARTITION BY e.source ORDER BY n.seq, n.id) AS rn, (SELECT count(*) FROM edges x WHERE x.kind = 'contains' AND x.source = n.id) AS size FROM edges e JOIN nodes n ON n.id = e.target WHERE e.kind = 'contains'),
l AS (SELECT of, string_agg('\n  ' || name || CASE WHEN docstring <> '' THEN ' — ' || substr(docstring, 1, 80) ELSE '' END, '' ORDER BY seq, id) FILTER (rn <= 20) AS files, string_agg('\n  ' || name || ' (' || size || ' symbols)', '' ORDER BY seq, id) AS modules, string_agg('\n  ' || name || '/ (' || size || ' files)', '' ORDER BY seq, id) AS repos FROM ch GROUP BY of)
SELECT n.id, CASE kind WHEN 'file' THEN 'File: ' || path || coalesce(files, '') WHEN 'module' THEN 'Module: ' || name || coalesce(modules, '') WHEN 'repository' THEN 'Repository: ' || name || coalesce(repos, '') WHEN 'function' THEN coalesce(nullif(docstring, ''), name) ELSE name END AS summary FROM nodes n LEFT JOIN l ON l.of = n.id""".replace("\\n", "\n"))
def heuristic_summaries(spark, d):
    return summaries.heuristic_summaries(_full(_nodes(spark, d)), _edges(spark, d))


@query(f"""WITH {SQL_GRAPH}, near AS (SELECT e.kind, e.source AS of, n.name, n.seq, n.id FROM edges e JOIN nodes n ON n.id = e.target WHERE e.kind IN ('contains', 'calls') UNION ALL SELECT 'called', e.target, n.name, n.seq, n.id FROM edges e JOIN nodes n ON n.id = e.source WHERE e.kind = 'calls'),
r AS (SELECT *, row_number() OVER (PARTITION BY of, kind ORDER BY seq, id) AS rn FROM near),
l AS (SELECT of, string_agg(name, '\n' ORDER BY rn) FILTER (kind = 'contains' AND rn <= 30) AS inside, string_agg(name, ', ' ORDER BY rn) FILTER (kind = 'calls' AND rn <= 10) AS calls, string_agg(name, ', ' ORDER BY rn) FILTER (kind = 'called' AND rn <= 10) AS called FROM r GROUP BY of),
c AS (SELECT n.*, inside, nullif(concat_ws('\n', 'File: ' || nullif(path, ''), 'Doc: ' || nullif(docstring, ''), 'Calls: ' || calls, 'Called by: ' || called), '') AS context, nullif(concat_ws('\n', path, inside), '') AS box FROM nodes n LEFT JOIN l ON l.of = n.id)
SELECT id, substr(CASE WHEN kind IN ('function', 'class', 'type') THEN coalesce(nullif(raw_code, ''), name) || coalesce('\n\n# Context\n' || context, '') ELSE coalesce(concat_ws('\n', box, CASE WHEN box IS NOT NULL THEN nullif(summary, '') END), name) END, 1, 4000) AS text FROM c""".replace("\\n", "\n"))
def embedding_texts(spark, d):
    out = summaries.embedding_texts(_full(_nodes(spark, d)), _edges(spark, d))
    return out.withColumn("text", F.when(F.col("text") == "", F.col("id")).otherwise(F.col("text")))


@query(f"WITH {SQL_NODES}, n AS (SELECT repo, kind, count(*) AS n FROM nodes GROUP BY ALL) SELECT repo, '{{' || string_agg('\"' || kind || '\":' || n, ',' ORDER BY kind) || '}}' AS counts FROM n GROUP BY repo")
def kinds_by_repository(spark, d):
    return catalog.kinds_by_repository(nodes(spark, d)).select("repo", map_to_json(F.col("counts")).alias("counts"))


@query("""WITH c AS (SELECT o_custkey % 25 AS repo, o_orderpriority AS author FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey % 25 ORDER BY o_orderdate DESC, o_orderkey DESC) <= 200), n AS (SELECT repo, author, count(*) AS n FROM c GROUP BY ALL),
o AS (SELECT repo, author FROM n QUALIFY row_number() OVER (PARTITION BY repo ORDER BY n DESC, author) = 1) SELECT r.repo, coalesce('user:' || author, 'unknown') AS owner FROM (SELECT DISTINCT c_custkey % 40 AS repo FROM customer) r LEFT JOIN o USING (repo)""")
def every_owner(spark, d):
    c = table(spark, d, "orders").select((F.col("o_custkey") % 25).alias("repo"), F.col("o_orderpriority").alias("author"), F.col("o_orderdate").alias("committed_at"), F.col("o_orderkey").alias("hash"))
    return catalog.every_owner(table(spark, d, "customer").select((F.col("c_custkey") % 40).alias("repo")), c)


@query("""WITH c AS (SELECT conv_id % 20 AS s, turn, conv_id AS node FROM conversations), l AS (SELECT s, max(turn) AS last FROM c GROUP BY 1)
SELECT s AS session_id, turn, node AS node_id FROM c UNION ALL SELECT user_id, coalesce(last, 0) + dense_rank() OVER (PARTITION BY user_id ORDER BY event_id), -event_id FROM events LEFT JOIN l ON s = user_id""")
def record_turns(spark, d):
    context = table(spark, d, "conversations").select((F.col("conv_id") % 20).alias("session_id"), "turn", F.col("conv_id").alias("node_id"))
    return sessions.record(context, table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), (-F.col("event_id")).alias("node_id")))


@query("""SELECT event_id, 'f' || event_id % 9 AS path, 'deleted' AS op FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 'g' || user_id, 'created' FROM events WHERE event_type = 'click'
UNION ALL SELECT event_id, 'f' || event_id % 9, event_type FROM events WHERE event_type <> 'click'""")
def move_events(spark, d):
    e = _events(spark, d).withColumns({"op": F.when(F.col("op") == "click", "moved").otherwise(F.col("op")), "dest": F.concat(F.lit("g"), F.col("repo").cast("string"))})
    return changes.moves_as_two(e).select("event_id", "path", "op")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 7 DAY THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM e)
SELECT user_id AS session_id, min(ts)::VARCHAR AS started, max(ts)::VARCHAR AS updated FROM b GROUP BY user_id, g""")
def live_sessions(spark, d):
    s = changes.live_sessions(table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts")))
    return s.select("session_id", F.col("started").cast("string").alias("started"), F.col("updated").cast("string").alias("updated"))


@query("""WITH s AS (SELECT s_suppkey AS k, ['class', 'type', 'function'][(s_suppkey % 3 + 1)::INT] AS kind FROM supplier), e AS (SELECT k, kind, k + 1 AS t, k % 2 = 0 AS base FROM s UNION ALL SELECT k, kind, k + 7, k % 2 = 1 FROM s)
SELECT e.k AS source, s.k AS target, CASE WHEN base AND e.kind <> 'function' THEN 'inherits' WHEN s.kind = 'function' THEN 'calls' ELSE 'uses_type' END AS kind FROM e JOIN s ON s.k = e.t""")
def link_signatures(spark, d):
    """Classes and types whose bases stand in the signature, or in the first line of the code; functions of the same form inherit nothing."""
    k = F.col("s_suppkey")
    name = lambda x: F.concat(F.lit("Supplier"), x.cast("string"))
    code = F.concat(F.lit("class own : "), name(k + 7), F.lit(" {\nuse "), name(k + 1))
    sign = F.when(k % 2 == 0, F.concat(F.lit("class own("), name(k + 1), F.lit("):"))).otherwise(F.lit(""))
    return link.link_names(table(spark, d, "supplier").select(k.alias("id"), name(k).alias("name"), F.element_at(F.array(F.lit("class"), F.lit("type"), F.lit("function")), (k % 3 + 1).cast("int")).alias("kind"), code.alias("raw_code"), sign.alias("signature")))


# -- lookups ----------------------------------------------------------------


@query(f"""WITH {SQL_GRAPH}, x AS (SELECT DISTINCT a.repo, b.repo AS other, edges.kind FROM edges JOIN nodes a ON a.id = source JOIN nodes b ON b.id = target WHERE a.repo <> b.repo),
q AS (SELECT *, trim(regexp_replace(regexp_replace(lower(repo), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '-') AS name FROM (SELECT DISTINCT repo FROM nodes)), o AS (SELECT *, 'component:default/' || trim(regexp_replace(regexp_replace(lower(other), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '-') AS ref FROM x)
SELECT 'Component' AS kind, name, 'library' AS type, 'unknown' AS owner, coalesce((SELECT string_agg(ref, ' ' ORDER BY other, kind) FROM o WHERE o.repo = q.repo), '') AS depends_on, 'r:' || (SELECT min(seq) FROM nodes n WHERE n.kind = 'repository' AND n.repo = q.repo) AS node_id FROM q""")
def catalog_entities(spark, d):
    n, e = _nodes(spark, d), _edges(spark, d)
    n = n.withColumns({"http_method": F.lit(None).cast("string"), "route_path": F.lit(None).cast("string")})
    imports = e.where("kind = 'imports'").join(n.select(F.col("id").alias("source"), "repo"), "source").select("repo", F.col("target").alias("name"), "seq")
    found = catalog.entities(catalog.catalogue(n, e, imports, quality.scores(n, e)))
    return found.select("kind", "name", "type", "owner", F.array_join("depends_on", " ").alias("depends_on"), "node_id")


@query(f"""WITH {SQL_GRAPH} SELECT 'child' AS role, source AS "of", target AS id FROM edges WHERE kind = 'contains' UNION ALL SELECT 'caller', target, source FROM edges WHERE kind = 'calls'""")
def neighbour_roles(spark, d):
    n, e = _nodes(spark, d), _edges(spark, d)
    of = lambda role, kind, into: graph.neighbours(n, e, kind, into).select(F.lit(role).alias("role"), "of", "id")
    return of("child", "contains", False).unionByName(of("caller", "calls", True))


@query(f"WITH {SQL_NODES}, f AS (SELECT repo, name, id, row_number() OVER (PARTITION BY repo, name ORDER BY seq, id) AS k FROM nodes WHERE kind IN {SYMBOL_KINDS!r}) SELECT repo, name, id FROM f WHERE k = 1")
def first_symbols(spark, d):
    n = _nodes(spark, d)
    return graph.first_named(n, n.select("repo", "name").distinct())


@query(f"""WITH {SQL_NODES}, p AS (SELECT path FROM nodes WHERE path <> '' GROUP BY 1), one AS (SELECT min(repo) AS lo, max(repo) AS hi FROM nodes), heads AS (SELECT split_part(path, '/', 1) AS part, repo, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY seq, id) AS k, seq, id FROM nodes WHERE path <> ''),
h AS (SELECT * FROM heads WHERE k = 1), c AS (SELECT path, h.repo, row_number() OVER (PARTITION BY path ORDER BY h.seq, h.id) AS k FROM p JOIN h ON starts_with(split_part(path, '/', 1), part))
SELECT p.path, coalesce(CASE WHEN lo = hi THEN lo END, c.repo, lo) AS repo FROM p LEFT JOIN c ON c.path = p.path AND c.k = 1, one""")
def repositories_of_files(spark, d):
    n = _nodes(spark, d)
    return changeset.infer_repositories(n, n.where("path != ''").select("path"))


@query("SELECT doc_id, 'Doc' || doc_id AS class_name, 2::BIGINT AS symbols, 'value' || doc_id AS last_name FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(92))")
def code_symbols(spark, d):
    """Each text as comment and string of a class: only the class, its method and what its code names are found."""
    docs = table(spark, d, "documents").where(F.col("text").isNotNull() & ~F.contains("text", F.lit("\\")))
    line = F.translate(F.regexp_replace("text", "[\\n\\r\\x0B\\x0C\\x85\\u2028\\u2029]", " "), '"', " ")
    code = F.concat(F.lit("class Doc"), "doc_id", F.lit(" {\n  // "), line, F.lit('\n  void run() { call("'), line, F.lit('", value'), "doc_id", F.lit("); }\n}\n"))
    files = materialize(docs.select(F.lit("r").alias("repo"), F.concat(F.col("doc_id").cast("string"), F.lit(".java")).alias("path"), code.alias("content"), "doc_id"))
    found = parse.symbols(files.drop("doc_id")).groupBy("path").agg(F.count("*").alias("symbols"), F.min_by("name", "seq").alias("class_name"))
    names = parse.code_identifiers(files.select("doc_id", "path", F.col("content").alias("code"), F.lit("java").alias("language")), ["doc_id", "path"])
    return found.join(names, "path").select("doc_id", "class_name", "symbols", F.array_max("identifiers").alias("last_name"))


_HEADS = ("function", "class", "import", "method", "field", "impl", "object", "lambda", "Enum", "odd", "type", "parameter", "SomeInterface")
_TAILS = ("_declaration", "_definition", "_item", "_statement", "")


@query(f"""WITH t AS (SELECT p_partkey AS id, ({list(_HEADS)!r})[(p_partkey % {len(_HEADS)} + 1)::INT] || ({list(_TAILS)!r})[(p_partkey % {len(_TAILS)} + 1)::INT] AS t, ({list(_HEADS)!r})[(p_partkey % {len(_HEADS)} + 1)::INT] AS head, p_size / 8.0 AS x FROM part)
SELECT id, t AS node_type, CASE WHEN NOT regexp_matches(t, '({'|'.join(DECLARATION_ENDS)})$') OR t IN {tuple(NO_SYMBOLS)!r} THEN NULL WHEN regexp_matches(lower(t), '{'|'.join(FUNCTION_HINTS)}') THEN 'function' WHEN regexp_matches(lower(t), '{'|'.join(CLASS_HINTS)}') THEN 'class' ELSE 'function' END AS class,
CASE WHEN head IN ('function', 'method', 'class', 'type', 'constant') THEN head ELSE 'function' END AS kind, round_even(x::DOUBLE, 2) AS rounded FROM t""")
def node_classes(spark, d):
    """What a parser's node types declare, and the kinds of symbols that are named so."""
    one_of = lambda words: F.element_at(F.array(*map(F.lit, words)), (F.col("p_partkey") % len(words) + 1).cast("int"))
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(one_of(_HEADS), one_of(_TAILS)).alias("node_type"), one_of(_HEADS).alias("head"), (F.col("p_size") / 8).alias("x"))
    return t.select("id", "node_type", node_class(F.col("node_type")).alias("class"), symbol_kind(F.col("head")).alias("kind"), rounded(F.col("x"), 2).alias("rounded"))


@query("""WITH k AS (SELECT o_orderkey AS id, o_orderkey::VARCHAR AS k, (o_custkey % 90 + 1)::INT AS a, (o_custkey % 7)::INT AS b, o_orderpriority AS w FROM orders)
SELECT id, 1 AS file_seq, 'src/x' || k || '.py' AS old_path, 'src/y' || k || '.py' AS new_path, 'renamed' AS status, a AS hunk_start, a + b AS hunk_end, 'import ' || w || ';;last' AS added, 'old' AS removed FROM k
UNION ALL SELECT id, 1, 'src/x' || k || '.py', 'src/y' || k || '.py', 'renamed', a + 200, a + 201, 'one', '' FROM k
UNION ALL SELECT id, 2, 'gone', 'gone', 'deleted', NULL, NULL, NULL, NULL FROM k UNION ALL SELECT id, 3, 'n', 'n', 'added', 1, 2, w, '' FROM k WHERE id % 2 = 0""")
def diff_parts(spark, d):
    """A diff for each order: a renamed file with two hunks, a deleted one and, in every other diff, a new one."""
    k, a, w = F.col("o_orderkey").cast("string"), F.col("o_custkey") % 90 + 1, F.col("o_orderpriority")
    text = F.concat(
        F.lit("before\ndiff --git a/src/x"), k, F.lit(".py b/src/y"), k, F.lit(".py\nsimilarity index 90%\nrename from src/x\n--- a/src/x\n+++ b/src/y\n@@ -1,2 +"), a.cast("string"), F.lit(","), (F.col("o_custkey") % 7).cast("string"),
        F.lit(" @@ def f\n+import "), w, F.lit("\n-old\n+++odd\n same\n+\n+last\n@@ -9 +"), (a + 200).cast("string"), F.lit(" @@\n+one\ndiff --git a/gone b/gone\ndeleted file mode 100644\n"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("diff --git a/n b/n\nnew file mode 100644\n@@ -0,0 +1 @@\n+"), w)).otherwise(F.lit("")),
    )
    found = parse.diff_hunks(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.alias("diff")))
    return found.withColumns({"added": F.array_join("added", ";"), "removed": F.array_join("removed", ";"), "file_seq": F.col("file_seq").cast("int")})


_ASKED = ("Customer#000000007", "else/where/Customer#000000011", "ASIA/CHINA", "parts/Brand#3/3", "no such")


@query(f"""WITH {SQL_NODES}, a AS (SELECT unnest({list(_ASKED)!r}) AS p), f AS (SELECT p AS asked, id, seq, path, kind, name, path = p OR ends_with(path, '/' || p) OR ends_with(p, '/' || path) AS same, kind = 'file' AND ends_with(path, split_part(p, '/', -1)) AS base FROM nodes, a),
l AS (SELECT 'file' AS how, asked, id, seq, CASE WHEN kind = 'file' AND same THEN 0 WHEN base THEN 1 END AS r FROM f UNION ALL SELECT 'target', asked, id, seq, CASE WHEN same AND kind = 'file' THEN 3 END FROM f
UNION ALL SELECT 'symbol', asked, id, seq, CASE WHEN same AND name = 'Order' || (SELECT min(o_orderkey) FROM orders WHERE o_custkey = 7) THEN 1 END FROM f)
SELECT how, asked, id FROM l WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY how, asked ORDER BY r, seq, id) = 1""")
def node_lookups(spark, d):
    """Files by the end of a path or by base name, and targets by file or by file and symbol; what is not there gives no row."""
    n = _nodes(spark, d)
    name = "Order" + str(table(spark, d, "orders").where("o_custkey = 7").agg(F.min("o_orderkey")).first()[0])
    found = spark.createDataFrame([], "how string, asked string, id string")
    for asked in _ASKED:
        for how, got in (("file", graph.file_node(n, asked)), ("target", graph.resolve_target(n, file=asked)), ("symbol", graph.resolve_target(n, file=asked, symbol=name))):
            found = found.unionByName(got.select(F.lit(how).alias("how"), F.lit(asked).alias("asked"), "id"))
    return found


@query(f"WITH {SQL_EDGES}, s AS (SELECT 's:' || min(s_suppkey) AS id FROM supplier) SELECT source, target, kind, CASE WHEN source = s.id THEN 'out' ELSE 'in' END AS direction FROM edges, s WHERE source = s.id OR (target = s.id AND kind = 'imports')")
def incident_edges(spark, d):
    e, one = _edges(spark, d), "s:" + str(table(spark, d, "supplier").agg(F.min("s_suppkey")).first()[0])
    return graph.incident(e, one, direction="out").unionByName(graph.incident(e, one, "imports", "in")).select("source", "target", "kind", "direction")


@query(f"WITH {SQL_GRAPH} SELECT source, target, 'shared_lib' AS kind FROM edges JOIN nodes a ON a.id = source JOIN nodes b ON b.id = target WHERE edges.kind = 'imports' AND a.repo <> b.repo")
def shared_imports(spark, d):
    return link.shared_imports(nodes(spark, d), edges(spark, d))


_WIRED = " OR ".join(f"contains(lower(path), '{w}')" for w in link.WIRING)


@query(f"""WITH {SQL_GRAPH}, n AS (SELECT id, kind, seq, CASE WHEN kind = 'file' AND seq % 10 = 3 THEN 'tests/test_Customer#' || lpad((seq - 1)::VARCHAR, 9, '0') ELSE path END AS path FROM nodes),
e AS (SELECT source, target, CASE WHEN kind = 'calls' THEN 'inherits' ELSE kind END AS kind FROM edges UNION ALL SELECT 'c:' || s_suppkey, 's:' || s_suppkey, 'contains' FROM supplier UNION ALL SELECT 'c:' || c_custkey, 'c:' || c_custkey + 1, 'imports' FROM customer),
f AS (SELECT id AS file, path, split_part(path, '/', -1) AS base FROM n WHERE kind = 'file'), s AS (SELECT file, n.id, n.kind FROM f JOIN e ON source = file AND e.kind = 'contains' JOIN n ON n.id = target),
up AS (SELECT DISTINCT file, s.id AS sym, target AS iface FROM s JOIN e ON source = s.id AND e.kind = 'inherits' WHERE s.kind IN ('class', 'type')),
t AS (SELECT path, base, seq, id FROM (SELECT n.*, split_part(path, '/', -1) AS base FROM n WHERE kind = 'file')), tests AS (SELECT file, t.id FROM f JOIN t ON t.base IN ('test_' || f.base, f.base || '_test') QUALIFY row_number() OVER (PARTITION BY f.path ORDER BY t.seq, t.path) = 1),
r AS (SELECT file, 'symbol' AS role, id FROM s UNION ALL SELECT file, 'interface', iface FROM up UNION ALL SELECT file, 'sibling', source FROM up JOIN e ON e.target = iface AND e.kind = 'inherits' WHERE source <> sym UNION ALL SELECT file, 'test', id FROM tests
UNION ALL SELECT file, 'wiring', n.id FROM s JOIN e ON e.target = s.id AND e.kind IN ('calls', 'uses_type') JOIN n ON n.id = e.source WHERE s.kind = 'class' AND ({_WIRED}) UNION ALL SELECT file, 'imports', target FROM f JOIN e ON source = file AND e.kind = 'imports' UNION ALL SELECT file, 'imported_by', source FROM f JOIN e ON target = file AND e.kind = 'imports')
SELECT DISTINCT file, role, r.id FROM r JOIN n ON n.id = r.id""")
def write_contexts(spark, d):
    """What to know before an edit of each file: suppliers are the classes of a file and inherit their parts, files import the next one, some are tests."""
    k = F.col("seq")
    n = _nodes(spark, d)
    n = materialize(n.withColumn("path", F.when((F.col("kind") == "file") & (k % 10 == 3), F.concat(F.lit("tests/test_Customer#"), F.lpad((k - 1).cast("string"), 9, "0"))).otherwise(F.col("path"))).select("id", "kind", "path", "seq"))
    e = edges(spark, d).select("source", "target", F.when(F.col("kind") == "calls", "inherits").otherwise(F.col("kind")).alias("kind"))
    s, c = F.col("s_suppkey").cast("string"), F.col("c_custkey")
    e = e.unionByName(table(spark, d, "supplier").select(F.concat(F.lit("c:"), s).alias("source"), F.concat(F.lit("s:"), s).alias("target"), F.lit("contains").alias("kind")))
    e = e.unionByName(table(spark, d, "customer").select(F.concat(F.lit("c:"), c.cast("string")).alias("source"), F.concat(F.lit("c:"), (c + 1).cast("string")).alias("target"), F.lit("imports").alias("kind")))
    return link.write_context(n, materialize(e), n.where("kind = 'file'"))


@query(f"""WITH {SQL_GRAPH}, u AS (SELECT target AS id, count(*) AS n FROM edges WHERE kind = 'uses_type' AND target IN (SELECT id FROM nodes WHERE kind = 'class' AND repo = 'ASIA') GROUP BY 1), m AS (SELECT id, n FROM u WHERE n > 15 ORDER BY n DESC, id LIMIT 1)
SELECT id || ' has ' || n || ' dependants, over 15' AS reason FROM m UNION ALL SELECT 'The change adds dependencies between repositories' UNION ALL SELECT * FROM (SELECT 'The change modifies the endpoint ' || name FROM nodes WHERE kind = 'type' AND repo = 'ASIA' ORDER BY seq LIMIT 1)""")
def review_reasons(spark, d):
    """A change of all of Asia's suppliers and parts, where parts are endpoints, with a call of them from each supplier."""
    n = _nodes(spark, d)
    own = n.where("kind IN ('class', 'type') AND repo = 'ASIA'")
    n = n.withColumn("kind", F.when(F.col("kind") == "type", "api_endpoint").otherwise(F.col("kind")))
    e = _edges(spark, d).where("kind != 'calls'")
    fresh = own.where("kind = 'class'").select(F.col("id").alias("source"), F.lit("x").alias("target"), F.lit("api_calls").alias("kind"))
    change = changeset.ChangeSet(n.where("false").select("path", F.lit("modified").alias("status")), own.select("id"), n.where("false"), fresh, fresh.where("false"))
    return changeset.review_reasons(n, e, change, [{"type": "impact_count"}, {"type": "cross_repo"}, {"type": "modifies_api"}])


_STATUS = "CASE event_type WHEN 'click' THEN 'renamed' WHEN 'signup' THEN 'added' WHEN 'error' THEN 'deleted' ELSE 'modified' END"


@query(f"""WITH c AS (SELECT {_STATUS} AS status, CASE WHEN event_type <> 'signup' THEN 'f' || user_id END AS old_path, CASE WHEN event_type = 'click' THEN 'g' || user_id WHEN event_type <> 'error' THEN 'f' || user_id END AS new_path FROM events)
SELECT old_path AS path, 'remove' AS action FROM c WHERE status <> 'added' UNION SELECT new_path, 'parse' FROM c WHERE status <> 'deleted'""")
def file_steps(spark, d):
    return parse.file_changes(_file_changes(spark, d))


@query(f"WITH c AS (SELECT 'r' || event_id % 6 AS repo, {_STATUS} AS s FROM events) SELECT repo, count(*) FILTER (s = 'added') AS added, count(*) FILTER (s = 'modified') AS modified, count(*) FILTER (s = 'deleted') AS deleted, count(*) FILTER (s = 'renamed') AS renamed FROM c GROUP BY repo")
def change_report(spark, d):
    return catalog.index_report(_file_changes(spark, d))


def _file_changes(spark, d) -> DataFrame:
    """Events as changes of a file by user: clicks rename it, sign-ups add it, errors delete it, the rest modify it."""
    kind, f = F.col("event_type"), F.concat(F.lit("f"), F.col("user_id").cast("string"))
    status = F.when(kind == "click", "renamed").when(kind == "signup", "added").when(kind == "error", "deleted").otherwise("modified")
    new = F.when(kind == "click", F.concat(F.lit("g"), F.col("user_id").cast("string"))).when(kind != "error", f)
    return table(spark, d, "events").select(F.concat(F.lit("r"), (F.col("event_id") % 6).cast("string")).alias("repo"), status.alias("status"), F.when(kind != "signup", f).alias("old_path"), new.alias("new_path"))


# -- what a store keeps -----------------------------------------------------


@query("SELECT user_id::VARCHAR AS node_id, max(ts)::VARCHAR AS last_retrieved, count(*) AS retrieval_count FROM events GROUP BY 1")
def retrieval_counts(spark, d):
    """Events appended to a store's log of retrievals in two parts, and what the log then tells of each node."""
    store = Store(spark, shared_dir(spark))
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("node_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    for part in (e.where("event_type = 'view'"), e.where("event_type != 'view'")):
        store.append_log("retrieval_log", part.drop("event_type"))
    return store.retrievals().withColumn("last_retrieved", F.col("last_retrieved").cast("string"))


@query("SELECT user_id::VARCHAR AS session_id, max(ts)::VARCHAR AS updated FROM events GROUP BY user_id HAVING max(ts) >= TIMESTAMP '2024-01-29 12:00:00'")
def kept_sessions(spark, d):
    """Sessions saved for every user, those of the last day left after a purge; what is asked for later finds the same."""
    store, now = Store(spark, shared_dir(spark)), F.lit("2024-01-30 12:00:00").cast("timestamp")
    ts = F.col("ts").cast("timestamp")
    last = table(spark, d, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.min(ts).alias("created_at"), F.max(ts).alias("updated_at")).withColumn("data", F.lit("{}"))
    store.save_session(last.withColumn("updated_at", F.col("created_at")))
    store.save_session(last)
    store.purge_sessions(now, 1)
    return sessions.unexpired(store.load("sessions"), now, 1).select("session_id", F.col("updated_at").cast("string").alias("updated"))


@query(f"""WITH {SQL_GRAPH}, n AS (SELECT id, kind, CASE WHEN kind = 'class' THEN 'new ' || name ELSE name END AS name FROM nodes WHERE kind <> 'type' OR seq % 3 <> 0), e AS (SELECT source, target FROM edges WHERE source NOT IN (SELECT id FROM nodes WHERE kind = 'type' AND seq % 3 = 0) AND target NOT IN (SELECT id FROM nodes WHERE kind = 'type' AND seq % 3 = 0)),
g AS (SELECT id, count(*) AS n FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY 1) SELECT id, kind, name, coalesce(g.n, 0) AS degree FROM n LEFT JOIN g USING (id)""")
def stored_graph(spark, d):
    """A graph in a store: suppliers get other names, every third part goes with its edges, and both tables are read as of one commit."""
    store = Store(spark, shared_dir(spark))
    n, e = _nodes(spark, d).select("id", "kind", "name", "seq"), edges(spark, d)
    store.commit(lambda _: {"nodes": n, "edges": e})
    store.upsert("nodes", n.where("kind = 'class'").withColumn("name", F.concat(F.lit("new "), "name")))
    store.remove_graph_nodes(store.existing("nodes", n.where("kind = 'type' AND seq % 3 = 0").select("id")))
    view = store.view()
    return view.load("nodes").join(graph.degrees(view.load("edges")), "id", "left").select("id", "kind", "name", F.coalesce("degree", F.lit(0)).alias("degree"))


@query("""WITH v AS (SELECT o_orderkey AS k, 'rule' || o_custkey % 7 AS rule_id, CASE o_orderkey % 3 WHEN 0 THEN 'block' WHEN 1 THEN 'warning' ELSE 'info' END AS severity FROM orders), t AS (SELECT count(*) AS n, count(*) FILTER (severity = 'block' AND rule_id <> 'rule1') AS open FROM v)
SELECT 'Check ' || CASE WHEN open = 0 THEN 'passed' ELSE 'failed' END || chr(10) || '  Rules: 7' || chr(10) || '  Files: 3' || chr(10) || '  Violations: ' || n AS line FROM t
UNION ALL SELECT '  ' || CASE WHEN severity <> 'block' THEN upper(severity) WHEN rule_id = 'rule1' THEN 'BLOCK (approved)' ELSE 'BLOCK (pending)' END || ' [' || rule_id || '] order ' || k || CASE WHEN k % 2 = 0 THEN chr(10) || '    File: f' || k ELSE '' END || CASE WHEN k % 5 = 0 THEN chr(10) || '    Fix: undo' ELSE '' END FROM v""")
def rule_report(spark, d):
    k = F.col("o_orderkey")
    v = table(spark, d, "orders").select(
        F.concat(F.lit("rule"), (F.col("o_custkey") % 7).cast("string")).alias("rule_id"), F.when(k % 3 == 0, "block").when(k % 3 == 1, "warning").otherwise("info").alias("severity"), F.concat(F.lit("order "), k.cast("string")).alias("message"),
        F.when(k % 2 == 0, F.concat(F.lit("f"), k.cast("string"))).alias("file_path"), F.when(k % 5 == 0, "undo").otherwise("").alias("suggested_fix"),
    )
    return reports.rule_report(guardrails.approve(v, F.array(F.lit("rule1"))), 7, 3).select("line")
