"""Quality classifier learned from positives and unlabelled text.

A text becomes a few statistics of its whole length; each is cut at quantiles of all training texts into indicator
columns, and a logistic model on them minimises the non-negative unbiased risk: trusted positives (label 1), unlabelled
web text as a mixture of both classes, and the estimated share of positives in it. That share is the least ratio of
the mass of all training texts to the positive mass above any threshold of a model that tells the two kinds apart.
Labelled training rows of both classes then fit two numbers that turn margins into probabilities.

All unlabelled training rows have a part in the risk: they are dealt by hash into chunks of a bounded size, each chunk is an
unlabelled sample of its own against the trusted positives, tasks minimise its risk, and the weights are averaged over chunks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, materialize, table

#: Labelled rows of each kind (positive; negative for calibration only) that the model is fitted on, at most: those with the least
#: hash of the id. Unlabelled rows are all used, so many to a chunk. Quantiles and the class prior are of all training texts too.
SAMPLE = 12_000
BINS = 16
FEATURES = 16
_SYMBOLS = np.frombuffer(b"#*$%&<>|", np.uint8)
_STOPS = np.frombuffer(b".,;:?", np.uint8)


def describe(text: str) -> list[float]:
    """Statistics of a whole text; all 0 for an empty one."""
    raw = text.encode("utf-8", "replace")
    words = text.split()
    if not words:
        return [0.0] * FEATURES
    n, w = len(raw), len(words)
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
    kinds = len(set(words))
    lines = [x for x in text.split("\n") if x.strip()]
    twice = sum(map(str.__eq__, words, words[1:]))
    return [
        math.log1p(w), n / w, h[65:91].sum(), h[48:58].sum(), h[33], h[124], h[_SYMBOLS].sum(), h[_STOPS].sum(), h[97:123].sum(), h[128:].sum(),
        kinds / w, math.log(kinds + 1) / math.log(w + 2), len(zlib.compress(raw, 1)) / n, twice / w, len(set(lines)) / max(1, len(lines)), w / max(1, len(lines)),
    ]


@dataclass
class Model:
    cuts: np.ndarray  # [feature, cut]
    weights: np.ndarray  # [feature * bins]
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    prior: float = 0.5
    losses: list[float] = field(default_factory=list)

    def columns(self, x: np.ndarray) -> np.ndarray:
        """The indicator that is set for each feature."""
        bins = (x[:, :, None] > self.cuts[None]).sum(2)
        return bins + np.arange(x.shape[1]) * (self.cuts.shape[1] + 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self.columns(x)].sum(1) + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * self.margin(x) + self.shift)


def _sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(z, float)))


def _descend(rows: list[np.ndarray], size: int, gradient, rounds: int = 400, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Adam on the weights of indicator columns; gradient(margins of each sample) -> derivative by each margin."""
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rounds + 1):
        ds = gradient([w[c].sum(1) + w[size] for c in rows])
        g = decay * w
        g[size] = 0
        for c, d in zip(rows, ds, strict=True):
            g[:size] += np.bincount(c.ravel(), np.repeat(d, c.shape[1]), size)
            g[size] += d.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:size], w[size]


def class_prior(pos: np.ndarray, above: Callable[[np.ndarray], np.ndarray], least: float = 0.4) -> float:
    """Share of positives among the unlabelled, from scores of a model that tells the two apart.

    above(thresholds) is the unlabelled mass from each threshold on. It is at least the prior times the positive mass there;
    the tightest threshold with at least `least` of the positives above it gives the estimate.
    """
    grid = np.quantile(pos, np.linspace(0, 1 - least, 50))
    return float(np.clip((above(grid) / np.maximum(_share_above(pos, grid), 1e-9)).min(), 0.05, 0.99))


def _share_above(margins: np.ndarray, grid: np.ndarray) -> np.ndarray:
    return (margins[:, None] >= grid).mean(0)


def cut_points(n: int) -> list[float]:
    """The quantiles that n rows are cut at: few rows, few bins; tails only where they hold rows."""
    bins = min(BINS, max(3, n // 150))
    tails = [q for q in (0.005, 0.01, 0.02, 0.04) if q * n >= 10]
    return sorted([*np.linspace(0, 1, bins + 1)[1:-1].tolist(), *tails, *(1 - q for q in tails)])


def _decay(n: int) -> float:
    return min(0.01, max(1e-4, 1 / n))


def tellers(p: np.ndarray, u: np.ndarray, hp: np.ndarray, hu: np.ndarray, size: int) -> np.ndarray:
    """Weights and bias of two models that tell positives from unlabelled rows, each learned from one half: [for half 0, for half 1]."""
    tell = lambda z: [-_sigmoid(-z[0]) / max(1, len(z[0])), _sigmoid(z[1]) / max(1, len(z[1]))]
    return np.array([np.r_[_descend([p[hp != half], u[hu != half]], size, tell, rounds=200, decay=_decay(len(p) + len(u)))] for half in (0, 1)])


def risk_weights(p: np.ndarray, u: np.ndarray, prior: float, size: int) -> np.ndarray:
    """Weights and bias of the least non-negative risk."""

    def gradient(z):
        # risk = prior * E_p[loss(z)] + max(0, E_u[loss(-z)] - prior * E_p[loss(-z)]), logistic loss
        negative = np.logaddexp(0, z[1]).mean() - prior * np.logaddexp(0, z[0]).mean()
        d_pos, d_unl = -prior * _sigmoid(-z[0]) / len(p), np.zeros(len(u))
        part_p, part_u = -prior * _sigmoid(z[0]) / len(p), _sigmoid(z[1]) / len(u)
        if negative >= 0:
            return [d_pos + part_p, d_unl + part_u]
        return [-part_p, -part_u]  # below zero: step back up

    return np.r_[_descend([p, u], size, gradient, decay=_decay(len(p) + len(u)))]


def calibrated(model: Model, labelled: tuple[np.ndarray, np.ndarray] | None) -> Model:
    if labelled is not None and len(set(labelled[1])) == 2:
        z, y = model.margin(labelled[0]), labelled[1]
        a, b = 1.0, 0.0
        for _ in range(500):  # Newton steps are unstable on separable rows; plain descent with a small penalty
            d = _sigmoid(a * z + b) - y
            a -= 0.5 * ((d * z).mean() / max(1.0, (z * z).mean()) + 1e-4 * a)
            b -= 0.5 * d.mean()
        model.scale, model.shift = a, b
    return model


def fit(pos: np.ndarray, unl: np.ndarray, labelled: tuple[np.ndarray, np.ndarray] | None = None) -> Model:
    """The model of rows of statistics that fit in memory: trusted positives, unlabelled rows, labelled (rows, 0/1) for calibration."""
    both = np.concatenate([pos, unl])
    model = Model(np.quantile(both, cut_points(len(both)), axis=0).T, np.zeros(0))
    size = both.shape[1] * (model.cuts.shape[1] + 1)
    p, u, hp, hu = model.columns(pos), model.columns(unl), np.arange(len(pos)) % 2, np.arange(len(unl)) % 2
    each = tellers(p, u, hp, hu, size)
    margins = lambda c, half: np.where(half == 0, *(w[:-1][c].sum(1) + w[-1] for w in each))
    model.prior = class_prior(margins(p, hp), lambda grid: _share_above(margins(u, hu), grid))
    w = risk_weights(p, u, model.prior, size)
    model.weights, model.bias = w[:-1], w[-1]
    return calibrated(model, labelled)


def half_of(ids) -> np.ndarray:
    """The half of each id in cross-fitting: a bit of its hash that the folds do not use."""
    return np.array([zlib.crc32(str(i).encode()) >> 2 & 1 for i in ids], int)


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model of docs and labels(doc_id, quality) outside the held-out fold; None without positives or other text.

    Rows with a null id are left out; of several labels of an id the least counts, and of several texts of a sampled id the one
    with the least statistics.
    """
    kind = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL").where(fold_of(F.col("doc_id")) != 2).groupBy("doc_id").agg(F.min("y").alias("y"))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL").where(fold_of(F.col("doc_id")) != 2)

    def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([describe(t.as_py() or "") for t in batch.column(1)], pa.list_(pa.float64()))], names=["doc_id", "x"])

    every = materialize(own.mapInArrow(statistics, "doc_id long, x array<double>"))
    least = lambda df: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    wanted = materialize(least(kind.where("y = 1")).unionByName(least(kind.where("y = 0"))))
    got = every.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")).orderBy("doc_id").toArrow().combine_chunks()
    ids, y = got.column("doc_id").to_pylist(), np.array(got.column("y").to_pylist(), int)
    if not (y == 1).any():
        return None
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, FEATURES)
    n = every.count()
    at = F.array(*map(F.lit, cut_points(n)))
    model = Model(np.array(every.agg(*(F.percentile_approx(F.col("x")[i], at, 10_000).alias(f"c{i}") for i in range(FEATURES))).first(), float), np.zeros(0))
    size = FEATURES * (model.cuts.shape[1] + 1)
    p, hp = model.columns(x[y == 1]), half_of(ids)[y == 1]
    shared = docs.sparkSession.sparkContext.broadcast((model, p, hp))
    # equal rows of one id count once in the risk, so no id or row makes a chunk large
    chunk = F.pmod(F.xxhash64("doc_id", "x"), F.lit(max(1, -(-n // rows))))
    unlabelled = materialize(every.distinct().withColumn("chunk", chunk))

    def averaged(learn, width: int) -> np.ndarray:
        """The mean, by rows, of learn(columns, halves of a chunk's rows), which gives `width` numbers."""

        def run(key, group):
            own, ids = _matrix(group.column("x").combine_chunks()), group.column("doc_id").to_numpy()
            by = np.lexsort((*own.T, ids))  # the same sums in whatever order the rows came
            w = learn(shared.value[0].columns(own[by]), half_of(ids[by].tolist()))
            return pa.table({"k": pa.array(range(width), pa.int32()), "w": pa.array(w * len(own)), "n": pa.array([len(own)] * width), "chunk": pa.array([key[0].as_py()] * width)})

        sums = unlabelled.groupBy("chunk").applyInArrow(run, "k int, w double, n long, chunk long")
        # summed in order of the chunks, so that the result does not change between runs
        parts = sums.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("chunk", "w", "n"))).alias("x"))
        total = parts.select("k", F.aggregate("x", F.lit(0.0), lambda a, c: a + c["w"]).alias("w"), F.aggregate("x", F.lit(0).cast("long"), lambda a, c: a + c["n"]).alias("n")).orderBy("k").collect()
        return np.array([r["w"] / r["n"] for r in total])

    each = averaged(lambda u, hu: tellers(shared.value[1], u, shared.value[2], hu, size).ravel(), 2 * (size + 1)).reshape(2, size + 1)

    def margins(c: np.ndarray, half: np.ndarray) -> np.ndarray:
        return np.where(half == 0, *(w[:-1][c].sum(1) + w[-1] for w in each))

    def above(grid: np.ndarray) -> np.ndarray:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, columns = np.zeros(len(grid) + 1, int), shared.value[0].columns
            for batch in batches:
                z = margins(columns(_matrix(batch.column(1))), half_of(batch.column(0).to_pylist()))
                total += [*(z[:, None] >= grid).sum(0), len(z)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["k", "n"])

        sums = every.mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").collect()
        return np.array([r["n"] for r in sums[:-1]], float) / sums[-1]["n"]

    model.prior = prior = class_prior(margins(p, hp), above)
    w = averaged(lambda u, _: risk_weights(shared.value[1], u, prior, size), size + 1)
    model.weights, model.bias = w[:-1], float(w[-1])
    return calibrated(model, (x, y.astype(float)))


def score(docs: DataFrame, model: Model | None, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of each row of docs. A null or empty text has the score of no words; without a model all score 0.5."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.5).alias("score"), F.lit(int(0.5 >= threshold)).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = np.array([describe(t.as_py() or "") for t in batch.column(1)]).reshape(-1, FEATURES)
            s = m.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Model | None, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score at least the threshold (all of them without a model)."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if len(batch):
                x = np.array([describe(t.as_py() or "") for t in batch.column(at)])
                yield batch.filter(pa.array(m.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_pu_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op8_pu_quality": op8_pu_quality}
ORACLES: dict[str, str] = {}
