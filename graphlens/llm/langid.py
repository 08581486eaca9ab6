"""Language identification by character language models with interpolated Kneser-Ney smoothing.

A text's words (runs of letters) are scored with one model per language, each letter given the three before it in its word;
the language with the least cross-entropy per letter is chosen. All languages share one sorted array of n-gram keys per
order with a column of log-probabilities for each language, so a batch of new words costs one binary search per letter.
Words are scored once for each task's bounded memory, texts add up their words' rows. Counts, the temperature of the scores
and the limits of rejection come from all training rows, and no n-gram is left out: models that are too large for a task's
memory stay tables, which the texts' n-grams join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import scratch
from .common import fold_of, materialize, table

ORDER = 4
#: Cells (n-grams of the highest order times languages) up to which tasks hold the models in memory; beyond, texts join them as tables.
HELD_CELLS = 8_000_000
#: Factors of the scores from which the temperature is chosen.
GRID = (0.25, 0.5, 1.0, 2.0, 4.0)
#: A text is rejected if its cross-entropy is SLACK beyond this share of those of the training texts taken for its language, of which there have to be LEAST.
SHARE, SLACK, LEAST = 0.999, 0.25, 20
#: Cross-entropies are counted in bins of 1 << BIN_BITS multiples of 1 / UNIT first.
BIN_BITS = 12
WORDS_HELD = 400_000
#: Log-probabilities are summed as whole multiples of 1 / UNIT, so sums do not depend on their order or on the models' form.
UNIT = 1 << 20
_EDGE = 1  # stands before a word's first letters and after its last
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of letters, A-Z lowered. Beyond ASCII, what is no letter is cut out of those words that have it."""
    out = []
    for w in text.encode("utf-8", "replace").translate(_LOWER).split():
        if w.isascii():
            out.append(w)
        else:
            s = w.decode()
            out += [w] if s.isalpha() else [p.encode() for p in "".join(c if c.isalpha() else " " for c in s).split()]
    return out


def gram_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of ORDER letters (16 bits each; code points beyond are folded) for every letter and end of the words, and their word numbers."""
    pad = chr(_EDGE) * (ORDER - 1)
    text = "".join(pad + w.decode() + chr(_EDGE) for w in words)
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    code = np.where(code < 0xE000, code, 0xE000 + code % 0x1FFF).astype(np.uint64)
    size = np.fromiter((len(w.decode()) for w in words), np.int64, len(words)) + ORDER
    ends = np.cumsum(size)
    key = np.zeros(len(code), np.uint64)
    for j in range(ORDER):
        key[ORDER - 1 :] = key[ORDER - 1 :] << np.uint64(16) | code[j : len(code) - ORDER + 1 + j]
    owner = np.repeat(np.arange(len(words)), size)
    real = np.arange(len(code)) - np.repeat(ends - size, size) >= ORDER - 1
    return key[real], owner[real]


@dataclass
class Models:
    langs: list[str]
    keys: list[np.ndarray]  # by order from 1: sorted n-gram keys of any language
    logp: list[np.ndarray]  # [n-gram, language]
    contexts: list[np.ndarray]  # by order from 2: sorted keys of contexts
    back: list[np.ndarray]  # [context, language]: log of the weight of the lower order
    unseen: np.ndarray  # [language]: log-probability of a letter that no model has
    temperature: float = 1.0
    limits: np.ndarray | None = None  # [language]: cross-entropy beyond which a text is rejected

    def letters(self, key: np.ndarray, order: int = ORDER) -> np.ndarray:
        """[key, language] log-probabilities."""
        if not order:
            return np.repeat(self.unseen[None], len(key), 0)
        own = self.keys[order - 1]
        at = np.minimum(np.searchsorted(own, key), len(own) - 1)
        hit = own[at] == key
        out = self.logp[order - 1][at]
        if not hit.all():
            rest = np.flatnonzero(~hit)
            lower = self.letters(key[rest] & np.uint64((1 << 16 * (order - 1)) - 1), order - 1)
            if order > 1:
                con = key[rest] >> np.uint64(16)
                have = self.contexts[order - 2]
                at = np.minimum(np.searchsorted(have, con), len(have) - 1)
                lower = lower + np.where((have[at] == con)[:, None], self.back[order - 2][at], 0)
            out[rest] = lower
        return out

    def words(self, words: list[bytes]) -> np.ndarray:
        """[word, language + 1]: summed log-probabilities in 1 / UNIT, and the number of letters scored."""
        key, owner = gram_keys(words)
        unique, back = np.unique(key, return_inverse=True)
        p = np.rint(self.letters(unique) * UNIT)[back]
        out = np.stack([*(np.bincount(owner, p[:, k], len(words)) for k in range(len(self.langs))), np.bincount(owner, minlength=len(words))], 1)
        return out.astype(np.int64)


@dataclass
class Tables:
    """The same models as shuffled tables."""

    langs: list[str]
    levels: list[DataFrame]  # by order from 1: lang, gram, n
    discounts: list[list[float]]  # by order from 1, by language
    letters: int
    temperature: float = 1.0
    limits: np.ndarray | None = None

    def log_probabilities(self, grams: DataFrame) -> DataFrame:
        """grams(gram) -> gram, logp of each language."""
        each = lambda f: F.array(*(f(k) for k in range(len(self.langs))))
        own = lambda k, x: F.coalesce(F.sum(F.when(F.col("lang") == self.langs[k], x)), F.lit(0)).cast("double")
        grams, low = grams.distinct(), None
        for order in range(1, ORDER + 1):
            level, discount = self.levels[order - 1], self.discounts[order - 1]
            counts = level.groupBy("gram").agg(each(lambda k: own(k, F.col("n"))).alias("c"))
            contexts = level.groupBy(_context("gram").alias("con")).agg(each(lambda k: own(k, F.col("n"))).alias("total"), each(lambda k: own(k, F.lit(1))).alias("kinds"))
            keys = grams.select(_suffix("gram", order).alias("gram")).distinct().withColumn("con", _context("gram"))
            keys = keys.join(counts, "gram", "left").join(contexts, "con", "left")
            if low is not None:
                keys = keys.withColumn("low", _suffix("gram", order - 1)).join(low, "low")

            def p(k, d=discount, first=low is None):
                c, total, kinds = (F.coalesce(F.col(x)[k], F.lit(0.0)) for x in ("c", "total", "kinds"))
                below = F.lit(1.0 / self.letters) if first else F.col("below")[k]
                return F.when(c > 0, F.greatest(c - d[k], F.lit(0.0)) / total).otherwise(0.0) + F.when(total > 0, d[k] * kinds / total).otherwise(1.0) * below  # noqa: B023

            low = keys.select(F.col("gram").alias("low"), each(p).alias("below"))
        return low.select(F.col("low").alias("gram"), F.transform("below", lambda x: F.log(x)).alias("logp"))

    def score(self, rows: DataFrame) -> DataFrame:
        """doc_id, lang, text -> doc_id, lang, letters, logp of each language, as _scorer."""
        parts = materialize(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_grams_of, _PARTS))
        used = parts.select("row", F.explode(F.arrays_zip("grams", "counts")).alias("g")).select("row", F.col("g.grams").alias("gram"), F.col("g.counts").alias("n"))
        logp = self.log_probabilities(used.select("gram"))
        sums = [F.sum(F.col("n") * F.rint(F.col("logp")[k] * UNIT).cast("long")) / F.lit(float(UNIT)) for k in range(len(self.langs))]
        got = used.join(logp, "gram").groupBy("row").agg(F.sum("n").cast("double").alias("letters"), F.array(*sums).alias("logp"))
        none = F.array(*(F.lit(0.0) for _ in self.langs))
        return parts.select("row", "doc_id", "lang").join(got, "row", "left").select("doc_id", "lang", F.coalesce("letters", F.lit(0.0)).alias("letters"), F.coalesce("logp", none).alias("logp"))


def _context(gram: str) -> Column:
    return F.shiftrightunsigned(gram, 16)


def _suffix(gram: str, order: int) -> Column:
    return F.col(gram) if order == ORDER else F.col(gram).bitwiseAND(F.lit((1 << 16 * order) - 1))


def tabulate(counts: DataFrame, langs: list[str]) -> Tables:
    """Tables from counts(lang, gram, n); continuation counts are those of different letters before."""
    levels = [counts]
    for order in range(ORDER - 1, 0, -1):
        levels.insert(0, materialize(levels[0].groupBy("lang", _suffix("gram", order).alias("gram")).agg(F.count("*").alias("n"))))
    discounts = []
    for level in levels:
        few = {r[0]: (r[1], r[2]) for r in level.groupBy("lang").agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).collect()}
        discounts.append([_discount(*few[x]) for x in langs])
    return Tables(langs, levels, discounts, max(2, levels[0].select("gram").distinct().count() + 1))


def _discount(once: int, two: int) -> float:
    return float(min(0.95, max(0.1, once / (once + 2 * two)))) if once + two else 0.5


def build(grams: dict[str, tuple[np.ndarray, np.ndarray]]) -> Models:
    """Models from {language: (keys of ORDER letters, counts)}."""
    langs = sorted(grams)
    level: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for name in langs:
        key, count = grams[name]
        own = [(key, count.astype(np.float64))]
        for order in range(ORDER - 1, 0, -1):  # continuation counts: different letters before
            own.insert(0, tuple(x.astype(t) for x, t in zip(np.unique(own[0][0] & np.uint64((1 << 16 * order) - 1), return_counts=True), (np.uint64, np.float64), strict=True)))
        level[name] = own
    letters = max(2, len(np.unique(np.concatenate([level[n][0][0] for n in langs]))) + 1)
    keys, logp, contexts, back = [], [], [], []
    lower = np.full((1, len(langs)), 1.0 / letters)
    unseen = np.zeros(len(langs))
    for order in range(1, ORDER + 1):
        union = np.unique(np.concatenate([level[n][order - 1][0] for n in langs]))
        con = np.unique(union >> np.uint64(16)) if order > 1 else np.zeros(1, np.uint64)
        weight, p = np.ones((len(con), len(langs))), np.zeros((len(union), len(langs)))
        for k, name in enumerate(langs):
            key, count = level[name][order - 1]
            once, two = (count == 1).sum(), (count == 2).sum()
            discount = _discount(once, two)
            at = np.searchsorted(con, key >> np.uint64(16)) if order > 1 else np.zeros(len(key), np.int64)
            total, kinds = np.bincount(at, count, len(con)), np.bincount(at, minlength=len(con))
            weight[:, k] = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            p[np.searchsorted(union, key), k] = np.maximum(count - discount, 0) / total[at]
        below = lower[np.searchsorted(keys[-1], union & np.uint64((1 << 16 * (order - 1)) - 1))] if order > 1 else lower
        at = np.searchsorted(con, union >> np.uint64(16)) if order > 1 else np.zeros(len(union), np.int64)
        p += weight[at] * below
        if order == 1:
            unseen = np.log(weight[0] / letters)
        else:
            contexts.append(con)
            back.append(np.log(weight))
        keys.append(union)
        logp.append(np.log(p))
        lower = p
    return Models(langs, keys, logp, contexts, back, unseen)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text -> lang, gram, count of a task; large counts are passed on early."""

    def flush():
        for lang, counter in held.items():
            words = list(counter)
            key, owner = gram_keys(words)
            unique, back = np.unique(key, return_inverse=True)
            count = np.bincount(back, np.fromiter(counter.values(), np.float64, len(words))[owner]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(unique), pa.string()), pa.array(unique.view(np.int64)), pa.array(count)], names=["lang", "gram", "n"])
        held.clear()

    held: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held.setdefault(lang, Counter()).update(words_of(text.as_py() or ""))
            if sum(map(len, held.values())) > WORDS_HELD:
                yield from flush()
    yield from flush()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, lang, text; lang is null in rows that are not learned from."""
    learned = F.col(text_col).isNotNull() & (fold_of(F.col(id_col).cast("long")) != 2)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when(learned, F.col("lang").cast("string")).alias("lang"), F.col(text_col).alias("text"))


def _learn(rows: DataFrame) -> Models | Tables | None:
    """Models of rows(lang, text), not calibrated yet."""
    counts = rows.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    counts = materialize(counts)
    langs = [r[0] for r in counts.select("lang").distinct().collect()]
    if not langs:
        return None
    if counts.count() * len(langs) <= HELD_CELLS:
        got = counts.select("lang", "gram", "n").toArrow()
        lang, gram, n = (got.column(c).to_numpy(zero_copy_only=False) for c in range(3))
        grams = {}
        for name in langs:
            own = lang == name
            key = gram[own].view(np.uint64)
            by = np.argsort(key)
            grams[name] = (key[by], n[own][by])
        return build(grams)
    return tabulate(counts, sorted(langs))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Models | Tables | None:
    """Models of the languages of the rows outside the held-out fold with a non-null lang; None if there are no such letters."""
    rows = _rows(docs, id_col, text_col).where("lang IS NOT NULL")
    models = _learn(rows)
    if models is not None:
        with scratch(docs.sparkSession):
            _calibrate(models, materialize(_judged(models, rows)))
    return models


_JUDGED = "doc_id long, best int, entropy double, scores array<double>, loss array<long>"
_PARTS = "row long, doc_id long, lang string, grams array<long>, counts array<long>"


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, lang, text, row -> row, doc_id, lang, the text's different grams and their counts."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            grams, counts = [], []
            for text in part.column(2):
                words = words_of(text.as_py() or "")
                key, n = np.unique(gram_keys(words)[0] if words else np.zeros(0, np.uint64), return_counts=True)
                grams.append(key.view(np.int64))
                counts.append(n)
            many = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(3), part.column(0), part.column(1), pa.array(grams, many), pa.array(counts, many)], names=["row", "doc_id", "lang", "grams", "counts"])


def _scorer(shared):
    """doc_id, lang, text -> doc_id, lang, letters, logp of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        width = len(models.langs) + 1
        number: dict[bytes, int] = {}
        rows = np.zeros((0, width), np.int64)
        for batch in batches:
            ids, langs = batch.column(0), batch.column(1)
            texts = batch.column(2)
            for start in range(0, len(texts), 256):
                if len(number) > WORDS_HELD:
                    number.clear()
                    rows = rows[:0]
                own = [words_of(t.as_py() or "") for t in texts.slice(start, 256)]
                new = list({w for ws in own for w in ws if w not in number})
                if new:
                    number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
                    rows = np.concatenate([rows, models.words(new)])
                sums = np.array([rows[[number[w] for w in ws]].sum(0) if ws else np.zeros(width, np.int64) for ws in own])
                cells = pa.ListArray.from_arrays(pa.array(np.arange(0, len(own) * (width - 1) + 1, width - 1, dtype=np.int32)), pa.array(sums[:, :-1].ravel() / UNIT))
                yield pa.RecordBatch.from_arrays([ids.slice(start, len(own)), langs.slice(start, len(own)), pa.array(sums[:, -1].astype(np.float64)), cells], names=["doc_id", "lang", "letters", "logp"])

    return run


def _margins(letters: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its cross-entropy, and [text, language] scores that grow with the root of the length."""
    mean = -logp / np.maximum(letters, 1)[:, None]
    return mean.argmin(1), mean.min(1), -mean * np.sqrt(np.maximum(letters, 1))[:, None]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _judged(models: Models | Tables, rows: DataFrame) -> DataFrame:
    """rows(doc_id, lang, text) -> doc_id, best language, its cross-entropy, its score by each factor of GRID, and for rows with a lang their losses (in 1 / UNIT).

    All but doc_id is null for texts without letters.
    """
    langs = models.langs
    number = {x: k for k, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, logp = batch.column(2).to_numpy(), batch.column(3).flatten().to_numpy().reshape(len(batch), len(langs))
            best, entropy, x = _margins(letters, logp)
            truth = np.array([number.get(k, -1) for k in batch.column(1).to_pylist()], np.int64)
            each, none = np.arange(len(batch)), letters == 0
            p = [_softmax(t * x) for t in GRID]
            scores = np.stack([v[each, best] for v in p], 1)
            loss = np.stack([-np.log(np.maximum(v[each, truth], 1e-12)) for v in p], 1)
            cols = [batch.column(0), pa.array(best.astype(np.int32), mask=none), pa.array(entropy, mask=none)]
            cols += [_lists(scores, none), _lists(np.rint(loss * UNIT).astype(np.int64), none | (truth < 0))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "best", "entropy", "scores", "loss"])

    if isinstance(models, Tables):
        return models.score(rows).mapInArrow(run, _JUDGED)
    score = _scorer(rows.sparkSession.sparkContext.broadcast(models))
    return rows.mapInArrow(lambda batches: run(score(batches)), _JUDGED)


def _lists(cells: np.ndarray, none: np.ndarray) -> pa.ListArray:
    offsets = np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells.ravel()), mask=pa.array(none))


def _at_rank(counts: dict[int, int], rank: int) -> int:
    """The value at a rank (from 0) of {value: count}."""
    values = np.array(sorted(counts))
    return int(values[np.searchsorted(np.cumsum([counts[v] for v in values.tolist()]), rank, "right")])


def _calibrate(models: Models | Tables, judged: DataFrame) -> None:
    """Temperature and limits from all judged rows with a loss: sums of losses, and quantiles by counts of bins, then of the values in the bins that hold them."""
    models.limits = np.full(len(models.langs), np.inf)
    judged = judged.where("loss IS NOT NULL").select("best", F.rint(F.col("entropy") * UNIT).cast("long").alias("entropy"), "loss")
    loss = judged.agg(*(F.sum(F.col("loss")[k]) for k in range(len(GRID)))).first()
    if loss[0] is None:
        return
    models.temperature = GRID[int(np.argmin(loss))]
    bins: dict[int, dict[int, int]] = {}
    for best, low, n in judged.groupBy("best", F.shiftright("entropy", BIN_BITS).alias("bin")).count().collect():
        bins.setdefault(best, {})[low << BIN_BITS] = n
    place = {k: SHARE * (n - 1) for k, own in bins.items() if (n := sum(own.values())) >= LEAST}
    ranks = {k: (int(np.floor(x)), int(np.ceil(x))) for k, x in place.items()}
    wanted = sorted({(k, _at_rank(bins[k], r) >> BIN_BITS) for k, two in ranks.items() for r in two})
    if not wanted:
        return
    fine = judged.sparkSession.createDataFrame(wanted, "best int, bin long")
    fine = judged.withColumn("bin", F.shiftright("entropy", BIN_BITS)).join(F.broadcast(fine), ["best", "bin"]).groupBy("best", "entropy").count().collect()
    for k, low in wanted:
        del bins[k][low << BIN_BITS]
    for best, entropy, n in fine:
        bins[best][entropy] = n
    for k, two in ranks.items():
        below, above = (_at_rank(bins[k], r) for r in two)
        models.limits[k] = (below + (place[k] - two[0]) * (above - below)) / UNIT + SLACK


def identify(docs: DataFrame, models: Models | Tables | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row of docs.

    A null text, or one without letters, is `und` with score 0; so is every text when there are no models. `rejected` marks
    texts whose cross-entropy is beyond what training texts of the language had. Repeated rows are scored alike.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("lang"), F.col(text_col).alias("text"))
    return _labels(models, rows if models is None else _judged(models, rows))


def _labels(models: Models | Tables | None, judged: DataFrame) -> DataFrame:
    if models is None:
        return judged.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected"))
    own = lambda values: F.get(F.array(*map(F.lit, values)), F.col("best"))
    limits = [np.inf] * len(models.langs) if models.limits is None else models.limits.tolist()
    score, rejected = F.col("scores")[GRID.index(models.temperature)], F.col("entropy") > own(limits)
    return judged.select("doc_id", F.coalesce(own(models.langs), F.lit("und")).alias("lang_pred"), F.coalesce(score, F.lit(0.0)).alias("score"), F.coalesce(rejected, F.lit(False)).alias("rejected"))


def train_identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """identify(docs, train(docs)), with each text scored once for calibration and result."""
    rows = _rows(docs, id_col, text_col)
    models = _learn(rows.where("lang IS NOT NULL"))
    if models is None:
        return _labels(None, rows)
    judged = materialize(_judged(models, rows))
    _calibrate(models, judged)
    return _labels(models, judged)


def op5_langid(spark, sf_dir):
    out = train_identify(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op5_langid": op5_langid}
ORACLES: dict[str, str] = {}
