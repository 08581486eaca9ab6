"""Quality rules: counts of each whole text, and a learned decision list on top of two fixed rules.

Everything on the executors is built-in column functions. The list is learned by sequential covering: a rule grows by the
threshold that gains most on two thirds of the labelled rows, is pruned on the other third, and the rows that it covers
leave; all that the learner sees are counts by feature and bin that Spark aggregates. The result is one ordered CASE.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, SPACES, fold_of, let, materialize, table, text_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Labelled rows that the list is learned from, at most; those with the least hash of the id.
SAMPLE = 20_000
BINS = 24
FEATURES = ("n_words", "symbol_share", "pipe_share", "bang_share", "upper_share", "repeat_share", "dup_line_share", "word_length", "distinct_share")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > self.cut if self.above else c <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _words(text: Column) -> Column:
    own = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(own == "", F.array().cast("array<string>")).otherwise(F.split(own, SPACES))


def repeated_words(words: Column) -> Column:
    """Words inside windows of 8 words that are found twice or more in the text."""
    n = F.size(words)
    starts = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(s: Column) -> Column:
        same = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
        twice = F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1))
        at = F.sort_array(F.transform(twice, lambda e: e["i"]))
        first = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        add = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(at, first, add, lambda a: a["n"])

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, covered))

    return F.when(n <= WINDOW, F.lit(0)).otherwise(let(starts, count))


def measure(text: Column) -> Column:
    """struct of the counts and shares of a text (null: none)."""

    def of_words(t: Column):
        def inner(words: Column) -> Column:
            n = F.size(words).cast("long")
            chars = F.length(_without(t, SPACE_CHARS)).cast("long")
            lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
            share = lambda x, of: x / F.greatest(of, F.lit(1))
            lacks = lambda s: F.length(t) - F.length(_without(t, s))
            counts = F.struct(
                n.alias("n_words"), chars.alias("word_chars"), lacks(SYMBOLS).cast("long").alias("n_symbols"),
                F.size(lines).alias("lines"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), repeated_words(words).cast("long").alias("n_repeat_words"),
            )
            return let(counts, lambda c: F.struct(
                *(c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                share(c["n_symbols"], c["word_chars"]).alias("symbol_share"), share(lacks("|"), c["word_chars"]).alias("pipe_share"), share(lacks("!"), c["word_chars"]).alias("bang_share"),
                share(lacks("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c["word_chars"]).alias("upper_share"), share(c["n_repeat_words"], c["n_words"]).alias("repeat_share"), share(c["n_dup_lines"], c["lines"]).alias("dup_line_share"),
                share(c["word_chars"], c["n_words"]).alias("word_length"), share(F.size(F.array_distinct(words)), c["n_words"]).alias("distinct_share"),
            ))

        return let(_words(t), inner)

    return let(text_of(text), of_words)


def base_failed(m: Column | None = None) -> Column:
    c = (lambda k: m[k]) if m is not None else F.col
    return (c("n_words") < 20) | (100 * c("n_repeat_words") > 30 * c("n_words"))


def _bins(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, dict[int, list[int]]]:
    """For each feature and bin, labelled rows: [bad, good]. Bin k holds values over k of the feature's cuts."""
    pairs = F.array(*(F.struct(F.lit(f).alias("f"), sum((F.col(f) > c).cast("int") for c in cs).alias("b")) for f, cs in cuts.items() if cs))
    got = rows.select(F.explode(pairs).alias("p"), "bad").groupBy("p.f", "p.b").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).collect()
    out: dict = {}
    for f, b, bad, good in got:
        out.setdefault(f, {})[b] = [bad, good]
    return out


def _best(stats, cuts, bad: int, good: int) -> tuple[float, Condition | None]:
    """The threshold with the largest gain in information about the bad rows that it covers."""
    before, best = math.log2(bad / (bad + good)) if bad else 0.0, (1e-9, None)
    for f, cs in cuts.items():
        for k, c in enumerate(cs):
            over = [sum(v[i] for b, v in stats.get(f, {}).items() if b > k) for i in (0, 1)]
            for above, (p, n) in ((True, over), (False, [bad - over[0], good - over[1]])):
                if p and (gain := p * (math.log2(p / (p + n)) - before)) > best[0]:
                    best = (gain, Condition(f, above, c))
    return best


def learn_rules(rows: DataFrame, max_rules: int = 12, max_conditions: int = 3, precision: float = 0.9, least: int = 5) -> list[Rule]:
    """An ordered list of conjunctions that mark bad rows. rows: FEATURES, bad, doc_id. No bad or no good rows give no rules."""
    probs = sorted({k / BINS for k in range(1, BINS)} | {0.0, 0.005, 0.01, 0.02, 0.03, 0.97, 0.98, 0.985, 0.99, 0.995, 1.0})
    found = rows.agg(*(F.percentile_approx(f, probs, 10_000).alias(f) for f in FEATURES)).first()
    ends = {f: sorted(set(found[f] or [])) for f in FEATURES}
    cuts = {f: [(a + b) / 2 for a, b in zip(e, e[1:], strict=False)] for f, e in ends.items()}  # half way between quantiles
    prune = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0
    rules: list[Rule] = []
    left = rows
    total = left.agg(F.count_if("bad")).first()[0]
    while total and len(rules) < max_rules:
        grow, rule = left.where(~prune), ()
        while len(rule) < max_conditions:
            stats = _bins(grow, cuts)
            bad, good = (sum(v[i] for v in next(iter(stats.values()), {}).values()) for i in (0, 1))
            if not bad or not good:
                break
            _, condition = _best(stats, cuts, bad, good)
            if condition is None:
                break
            rule += (condition,)
            grow = grow.where(condition.column())
        if not rule:
            break
        prefix = [F.lit(True)]
        for c in rule:
            prefix.append(prefix[-1] & c.column())
        counts = left.where(prune).agg(*(x for k, p in enumerate(prefix[1:]) for x in (F.count_if(p & F.col("bad")).alias(f"p{k}"), F.count_if(p & ~F.col("bad")).alias(f"n{k}")))).first()
        worth = [(counts[f"p{k}"] - counts[f"n{k}"]) / max(1, counts[f"p{k}"] + counts[f"n{k}"]) for k in range(len(rule))]
        rule = rule[: max(range(len(rule)), key=lambda k: (worth[k], -k)) + 1]
        fits = prefix[len(rule)]
        p, n = left.agg(F.count_if(fits & F.col("bad")), F.count_if(fits & ~F.col("bad"))).first()
        if p < least or p < precision * (p + n):
            break
        rules.append(rule)
        left = left.where(~fits)
    return rules


def decision(rules: list[Rule], m: Column | None = None) -> Column:
    """The text of the first rule that fits, else null: one ordered CASE."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        fits = F.lit(True)
        for c in rule:
            x = m[c.feature] if m is not None else F.col(c.feature)
            fits = fits & (x > c.cut if c.above else x <= c.cut)
        out = F.when(fits, " and ".join(map(str, rule))).otherwise(out)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """FEATURES, doc_id and bad of at most `rows` labelled documents outside the held-out fold.

    Of an id's labels the least counts, so one bad label makes it bad; of its texts the least counts. Null ids and labels teach
    nothing.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 0).alias("bad")).where("doc_id IS NOT NULL AND bad IS NOT NULL").where(fold_of(F.col("doc_id")) != 2)
    own = own.groupBy("doc_id").agg(F.max("bad").alias("bad")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(own), "doc_id")
    texts = texts.groupBy("doc_id", "bad").agg(F.min("text").alias("text"))
    return materialize(texts.select("doc_id", "bad", measure(F.col("text")).alias("m")).select("doc_id", "bad", "m.*"))


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, kept and rule of every row of docs.

    A null or empty text has no words and fails; repeated rows are judged alike; null ids pass through; an empty table
    gives an empty result. Other columns of docs are not looked at.
    """
    m = docs.select(F.col(id_col).cast("long").alias("doc_id"), measure(F.col(text_col)).alias("m")).select("doc_id", "m.*")
    failed, rule = base_failed(), decision(rules)
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & rule.isNull()).alias("kept"), rule.alias("rule"))


def keep_good(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that no rule rejects."""

    def good(m: Column) -> Column:
        return ~base_failed(m) & decision(rules, m).isNull()

    return docs.where(let(measure(F.col(text_col)), good))


def op1_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return judge(docs, learn_rules(labelled_sample(docs, table(spark, sf_dir, "labels"))))


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES: dict[str, str] = {}
