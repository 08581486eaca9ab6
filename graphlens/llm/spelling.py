"""Groups of spelling variants by an index of variable-length grams.

A gram starts at each place of a word (between marks of its begin and end) and grows from two characters while it is frequent
in the vocabulary, up to a longest length; grams that lie in an earlier one are left out. The dictionary that decides this holds
frequent grams only; a gram counts as frequent above a share of all grams, so the dictionary's size is bounded at any size
of the vocabulary.

One edit at character i changes grams that end at i to i + longest - 1, and no others: a gram depends on its own characters,
and is left out only for an earlier gram of at most the longest length that reaches its end. This bounds the affected grams
of each word. So for each gram k, either it is unaffected with all before it, and the words agree up to its end; or the first
gram that ends `longest` or more characters later is unaffected, and they agree from its start on. The index lists words by
(gram, what is before it) and (gram, what is behind it). A word merges two lists, the pair k that is shortest for it, and
verifies what it finds there. The longest length is chosen by the shortest word so that such a pair always exists.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table, text_of

SHORTEST = 2
#: A gram is frequent above this count, and above this share of all grams of its length: at most 1 / SHARE grams are.
FREQUENT, SHARE = 32, 1 / 100_000
BEGIN, END = "\x02", "\x03"
LETTERS = "A-Za-zÀ-ÿ"


def longest_for(min_length: int) -> int:
    """The longest gram for which each word of min_length characters has two grams whose ends are that far apart."""
    return max(SHORTEST, (min_length + 2) // 2)


def decompose(word: str, frequent: set[str], longest: int) -> list[tuple[int, int]]:
    """(first, last) characters of the grams of BEGIN + word + END, both inclusive; their ends increase."""
    text, out, last = BEGIN + word + END, [], -1
    for p in range(len(text) - SHORTEST + 1):
        q = SHORTEST
        while q < longest and p + q < len(text) and text[p : p + q] in frequent:
            q += 1
        if p + q - 1 > last:
            last = p + q - 1
            out.append((p, last))
    return out


def pairs_of_lists(word: str, grams: list[tuple[int, int]], longest: int) -> list[tuple[str, str]]:
    """(what is up to a gram's end, what is from a later gram's start on) such that one edit leaves one of both as it is."""
    text, out = BEGIN + word + END, []
    for _, last in grams:
        after = next((p for p, e in grams if e >= last + longest), None)
        if after is not None:
            out.append((text[: last + 1], text[after:]))
    return out


def frequent_grams(words: DataFrame, longest: int) -> set[str]:
    """Grams of SHORTEST to longest - 1 characters that are frequent among words(word); bounded by SHARE."""
    text = words.select(F.concat(F.lit(BEGIN), "word", F.lit(END)).alias("text"))
    out: set[str] = set()
    for q in range(SHORTEST, longest):
        grams = text.where(F.length("text") >= q).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - (q - 1)), lambda i: F.substring("text", i, F.lit(q)))).alias("gram"))
        counts = materialize(grams.groupBy("gram").count())
        limit = max(FREQUENT, int((counts.agg(F.sum("count")).first()[0] or 0) * SHARE))
        out |= {r[0] for r in counts.where(F.col("count") > limit).select("gram").collect()}
    return out


def near_words(words: DataFrame, min_length: int) -> DataFrame:
    """word, n, other, other_n: each pair of words(word, n) at one insertion, deletion or replacement, in both directions.

    Words are distinct and have min_length characters at least, which is 2 or more.
    """
    spark, longest = words.sparkSession, longest_for(min_length)
    dictionary = spark.sparkContext.broadcast(frequent_grams(words, longest))

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = dictionary.value
        for batch in batches:
            out = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text, grams = BEGIN + word + END, decompose(word, frequent, longest)
                out += [(False, text[: e + 1], word, n) for _, e in grams] + [(True, text[p:], word, n) for p, _ in grams]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.bool_(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["behind", "list", "word", "n"])

    def choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = dictionary.value
        for batch in batches:
            out = [(word, n, a, b) for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for a, b in pairs_of_lists(word, decompose(word, frequent, longest), longest)]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["word", "n", "upto", "from"])

    words = words.select("word", "n")
    index = materialize(words.mapInArrow(postings, "behind boolean, list string, word string, n long"))
    lengths = materialize(index.groupBy("behind", "list").agg(F.count("*").alias("k")).where("k > 1"))
    chosen = words.mapInArrow(choices, "word string, n long, upto string, from string")
    for col, behind in (("upto", False), ("from", True)):
        chosen = chosen.join(lengths.where(F.col("behind") == behind).select(F.col("list").alias(col), F.col("k").alias(f"k_{col}")), col, "left")
    cost = F.coalesce("k_upto", F.lit(0)) + F.coalesce("k_from", F.lit(0))
    best = materialize(chosen.groupBy("word", "n").agg(F.min(F.struct(cost.alias("cost"), "upto", "from", "k_upto", "k_from")).alias("x")).select("word", "n", "x.*"))
    probes = best.where("k_upto IS NOT NULL").selectExpr("word", "n", "false behind", "upto list", "cast(null as string) upto")
    probes = probes.unionByName(best.where("k_from IS NOT NULL").selectExpr("word", "n", "true behind", "from list", "upto"))
    other = index.select("behind", "list", F.col("word").alias("other"), F.col("n").alias("other_n"))
    near = (F.abs(F.length("word") - F.length("other")) <= 1) & (F.levenshtein("word", "other", 1) == 1)
    fresh = F.col("upto").isNull() | ~F.concat(F.lit(BEGIN), "other", F.lit(END)).startswith(F.col("upto"))  # else the first list has it
    on = (probes["behind"] == other["behind"]) & (probes["list"] == other["list"]) & near & fresh
    return probes.join(other, on).select("word", "n", "other", "other_n")


def group_variants(words: DataFrame, min_length: int, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for words(word, n).

    form is the near word of largest n (ties: the smallest), if that n is at least ratio times the word's; root follows forms
    to the last one. An empty table gives an empty result.
    """
    words = materialize(words.select("word", "n"))
    near = near_words(words, min_length).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("x"))
    found = words.join(near.select("word", "n_near", F.col("x.other").alias("other"), (-F.col("x.less")).alias("other_n")), "word", "left")
    has = F.col("other_n") >= ratio * F.col("n")
    found = materialize(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("other")).alias("form"), F.when(has, F.col("other_n")).alias("form_n")))
    ways = materialize(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:  # n grows ratio-fold at each step, so forms are few steps long
        up = ways.select(F.col("word").alias("root"), F.col("root").alias("far"))
        more = materialize(ways.join(up, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        ways = more.drop("moved")
        if not more.where("moved").limit(1).count():
            break
    return found.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def typed_words(docs: DataFrame, min_length: int = 6, least: int = 5, every: int = 199) -> DataFrame:
    """word, n: runs of letters of all texts with ASCII letters lower-cased, of min_length characters and `least` occurrences.

    Of a run whose crc32 (of id, colon and run) is a multiple of `every`, one character is left out. A null text has no
    runs, and a null id reads as empty. Repeated rows count again.
    """
    run = F.explode(F.regexp_extract_all(text_of("text"), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run")).withColumn("run", ascii_lower(F.col("run")))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, cut).otherwise(F.col("run"))
    return runs.withColumn("h", h).select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def op11_spelling_variants(spark, sf_dir):
    return group_variants(typed_words(table(spark, sf_dir, "documents")), 6)


QUERIES = {"op11_spelling_variants": op11_spelling_variants}
ORACLES = {
    "op11_spelling_variants": r"""
WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents),
u AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n FROM t WHERE length(r) >= 6 GROUP BY 1, 2),
b AS (SELECT r, n, list_transform(range(1, length(x) + 1, 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT)) AS b FROM (SELECT r, n, hex(encode(d || ':' || r)) AS x FROM u)),
h AS (SELECT r, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, y: list_reduce(list_prepend(xor(c, y), range(8)), lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) AS h FROM b),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
v AS (SELECT word, n, 0 AS i, word AS k FROM w UNION ALL SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM v a JOIN v b ON a.k = b.k AND a.word <> b.word AND (a.i = b.i OR a.i = 0 OR b.i = 0)),
f AS (SELECT word, count(*) AS n_near, min({'less': -other_n, 'other': other}) AS x FROM p GROUP BY word),
g AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -x.less >= 5 * n THEN x.other END AS form, CASE WHEN -x.less >= 5 * n THEN -x.less END AS form_n FROM w LEFT JOIN f ON f.word = w.word),
s AS (SELECT word, word AS step, 0 AS k FROM g UNION ALL SELECT s.word, g.form, k + 1 FROM s JOIN g ON g.word = s.step WHERE g.form IS NOT NULL)
SELECT g.word, form, root, n, n_near, form_n FROM g JOIN (SELECT word, max_by(step, k) AS root FROM s GROUP BY word) r ON r.word = g.word
""",
}
