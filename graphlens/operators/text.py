"""Text retrieval: BM25, name and route matches, the blend of seeds, and the intent of a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import normalize_route, split_name
from ..schemas import INTENTS, REQUEST, STOPWORDS, TEXT_WORD
from ..sources.shared import materialize


def tokens(text: Column) -> Column:
    """Lower-cased words of three characters and more, each followed by the parts of its name."""
    found = F.regexp_extract_all(text, F.lit(TEXT_WORD), F.lit(0))
    return F.flatten(F.transform(found, lambda w: F.concat(F.array(F.lower(w)), split_name(w))))


def bm25(docs: DataFrame, query: str, k: int = 9, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """docs(id, text) -> id, score of the k best, divided by the best score; scores of 0 and less are dropped.

    Terms in over half of the documents take epsilon times the mean idf. Query terms count as often as they occur.
    Documents are tokenised once: words are counted before their names are split, and term counts go to a table in the shared folder.
    Rows with the same id are one document.
    """
    spark = docs.sparkSession
    found = docs.select("id", F.explode(F.regexp_extract_all("text", F.lit(TEXT_WORD), F.lit(0))).alias("w")).groupBy("id", "w").agg(F.count("*").alias("k"))
    parts = found.select("id", "k", F.explode(F.concat(F.array(F.lower("w")), split_name(F.col("w")))).alias("term"))
    terms = materialize(parts.groupBy("id", "term").agg(F.sum("k").alias("tf")))
    by_doc = terms.groupBy(F.col("id").alias("of")).agg(F.sum("tf").alias("dl"))
    lengths = by_doc.agg(F.count("*").alias("n"), F.avg("dl").alias("avg"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(lengths.select("n"))).select("term", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = idf.agg(F.avg("idf").alias("mean"))
    asked = spark.range(1).select(F.explode(tokens(F.lit(query))).alias("term")).groupBy("term").agg(F.count("*").alias("qn"))
    weights = idf.join(F.broadcast(asked), "term").crossJoin(F.broadcast(mean)).select("term", "qn", F.when(F.col("idf") < 0, epsilon * F.col("mean")).otherwise(F.col("idf")).alias("idf"))
    words = [r[0] for r in asked.collect()]
    postings = terms.where(F.col("term").isin(words)).join(by_doc, F.col("id").eqNullSafe(F.col("of")))
    part = F.col("qn") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg")))
    scores = postings.join(F.broadcast(weights), "term").crossJoin(F.broadcast(lengths.select("avg"))).groupBy("id").agg(F.sum(part).alias("raw"))
    best = scores.orderBy(F.desc("raw"), "id").limit(k)
    top = F.max("raw").over(Window.partitionBy(F.lit(0)))  # k rows
    return best.withColumn("score", F.when(top > 0, F.col("raw") / top)).where("raw > 0").select("id", "score")


def query_words(query: str) -> list[str]:
    """Parts of the question's words, longer than two letters and no stop words."""
    import re

    out = []
    for w in query.split():
        w = re.sub("([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub("([a-z])([A-Z])", r"\1 \2", w))
        out += [p.lower() for p in re.split("[^a-zA-Z0-9]+", w)]
    return sorted({w for w in out if len(w) > 2 and w not in STOPWORDS})


def name_match(nodes: DataFrame, query: str, boost: float = 0.7, k: int = 30) -> DataFrame:
    """nodes(id, name, path) -> id, score: share of the question's words in the name, else a word inside the path."""
    words = query_words(query)
    if not words:
        return nodes.select("id", F.lit(0.0).alias("score")).limit(0)
    hit = F.size(F.array_intersect(split_name(F.col("name")), F.array(*map(F.lit, words)))) / F.lit(float(len(words)))
    low = F.lower(F.coalesce("path", F.lit("")))
    in_path = F.lit(False)
    for w in words:
        in_path = in_path | F.contains(low, F.lit(w))
    score = F.when(hit > 0, boost * (0.5 + 0.5 * hit)).when(in_path, F.lit(boost * 0.4))
    return nodes.select("id", score.alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), "id").limit(k)


def route_match(endpoints: DataFrame, query: str) -> DataFrame:
    """endpoints(id, http_method, route_path) -> id, score: 1.0 for the path, 1.2 with the method, 0.6 if methods differ.

    Only {..} parameters are collapsed here; numbers and :names are left as they are. The path may stand behind a slash at the end of a route.
    """
    import re

    found = re.search(REQUEST, query, re.IGNORECASE)
    if not found:
        return endpoints.select("id", F.lit(0.0).alias("score")).limit(0)
    method = (found[1] or "").upper()
    wanted = re.sub(r"\{[^}]+\}", "{_}", found[2]).rstrip("/").lower() or "/"
    path = F.lower(F.regexp_replace(F.regexp_replace("route_path", "\\{[^}]+\\}", "{_}"), "/+$", ""))
    path = F.when(path == "", F.lit("/")).otherwise(path)
    own = F.upper(F.coalesce("http_method", F.lit("")))
    score = F.when(F.lit(method == "") | (own == ""), 1.0).when(own == method, 1.2).otherwise(0.6)
    return endpoints.where((path == wanted) | F.endswith(path, F.lit("/" + wanted))).select("id", score.alias("score"))


def blend(vector: DataFrame, keyword: DataFrame, alpha: float) -> DataFrame:
    """Seeds(id, score) of both kinds: both alpha * v + (1 - alpha) * k, vector alone unchanged, keyword alone (1 - alpha) * k."""
    v, k = vector.select("id", F.col("score").alias("v")), keyword.select("id", F.col("score").alias("k"))
    score = F.when(F.col("k").isNull(), F.col("v")).when(F.col("v").isNull(), (1 - alpha) * F.col("k")).otherwise(alpha * F.col("v") + (1 - alpha) * F.col("k"))
    return v.join(k, "id", "full_outer").select("id", score.alias("score"))


def raise_scores(seeds: DataFrame, more: DataFrame) -> DataFrame:
    """The larger score of either."""
    return seeds.unionByName(more).groupBy("id").agg(F.max("score").alias("score"))


def intent(text: Column) -> Column:
    """Intent of a question: the family with most matching patterns; the first wins ties; general if none matches."""
    counts = {name: sum((text.rlike("(?i)" + p).cast("int") for p in patterns), F.lit(0)) for name, patterns in INTENTS.items()}
    top = F.greatest(*counts.values())
    out = F.lit("general")
    for name, n in reversed(counts.items()):
        out = F.when((n == top) & (top > 0), name).otherwise(out)
    return out


def routes(pages: DataFrame) -> DataFrame:
    return pages.withColumn("route", normalize_route(F.col("url")))
