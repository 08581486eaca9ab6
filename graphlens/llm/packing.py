"""Best-fit packing of token sequences, by residual levels.

Each document is encoded, ended with the separator and cut into pieces of at most one sequence. A group of pieces is packed
best-fit, largest first, and bins that are nearly full are emitted; its underfull bins are items of the next level, where
groups are merged and packed again, up the tree until one group is left.

Bins of one fill are alike, so a level packs counts: its plan takes how many underfull bins of each fill each group below has,
at most one number per fill and group, and gives runs of bins, however many bins there are. Rows stay where they are: a row
is a piece with its bin's group, fill and rank, and joins the run that its bin falls into. So no bin is closed early for want
of room, and no task holds the bins of a level.
"""

from __future__ import annotations

import bisect
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ByteBpe, byte_bpe_path, load, own_encoder
from .common import materialize, narrow_side, table

SEQUENCE = 2048
#: A bin with at most so many free tokens is emitted at once.
SLACK = 8
#: Texts with so much white space in a run go to the encoder of this package; the fast one runs out of stack on such runs.
_LONG_SPACE = re.compile(r"\s{20000}")
#: Groups that are merged into one at the next level.
FAN_IN = 8

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_ROW = _PIECE + ", sequence_id long, offset long, done boolean, group long, fill long, rank long"
#: Items `lo` to `hi` (by rank) of a group's fill go into bins from `bin` on, `each` a bin, the first of them after `skip` others of
#: the run; bins of the run had `base` tokens before. The bins end with `fill_out` tokens and ranks from `rank_out` on.
_RUN = "group long, fill long, lo long, hi long, parent long, bin long, each long, skip long, base long, done boolean, fill_out long, rank_out long"
_RUN_NAMES = [x.split()[0] for x in _RUN.split(", ")]


@functools.lru_cache(maxsize=2)
def _fast_encoder(path: str):
    import tiktoken

    bpe: ByteBpe = load(path)
    from public_tokenizers import PATTERN

    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=bpe.ids, special_tokens=bpe.specials)


def cut(length: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter."""
    first = length % size or min(length, size)
    return [(0, first), *((s, size) for s in range(first, length, size))]


def best_fit(counts: dict[int, int], capacity: int = SEQUENCE) -> tuple[list[tuple[int, ...]], list[tuple[int, int, int]]]:
    """Best-fit decreasing of counts[size] items, in runs: (placed, bins).

    placed: (size, first item, past the last, first bin, items a bin, tokens before them). bins: (first, past the last, fill).
    Free bins are stacks by residual. The fullest bin that takes an item takes as many of its size as fit, and bins of one
    residual do so alike, so a run of them is one step; each size leaves at most three runs more.
    """
    placed, stacks, mask, made = [], [[] for _ in range(capacity + 1)], 0, 0

    def push(residual: int, first: int, past: int) -> None:
        nonlocal mask
        if first < past:
            stacks[residual].append((first, past))
            mask |= 1 << residual

    for size in sorted(counts, reverse=True):
        at, n = 0, counts[size]
        while at < n:
            high = mask >> size
            if not high:  # new bins
                more = -(-(n - at) // (capacity // size))
                push(capacity, made, made + more)
                made += more
                continue
            residual = size + (high & -high).bit_length() - 1
            first, past = stacks[residual].pop()
            if not stacks[residual]:
                mask &= ~(1 << residual)
            each = residual // size
            whole = min(past - first, (n - at) // each)
            if whole:
                placed.append((size, at, at + whole * each, first, each, capacity - residual))
                push(residual - each * size, first, first + whole)
                at, first = at + whole * each, first + whole
            if first < past and at < n:  # one bin takes what is left of this size
                placed.append((size, at, n, first, n - at, capacity - residual))
                push(residual - (n - at) * size, first, first + 1)
                at, first = n, first + 1
            push(residual, first, past)
    return placed, sorted((first, past, capacity - residual) for residual, runs in enumerate(stacks) for first, past in runs)


def plan(below: list[tuple[int, int, int]], parent: int, size: int = SEQUENCE, last: bool = False) -> list[tuple]:
    """Runs (see _RUN) of packing below: (group, fill, bins of that fill) of the groups merged into parent."""
    counts: dict[int, int] = {}
    starts: dict[int, list[tuple[int, int, int]]] = {}  # fill -> (first item, past the last, group)
    for group, fill, n in sorted(below):
        at = counts.get(fill, 0)
        starts.setdefault(fill, []).append((at, at + n, group))
        counts[fill] = at + n
    placed, bins = best_fit(counts, size)
    firsts = np.array([b[0] for b in bins], np.int64)
    ranks, seen = [], {}
    for first, past, fill in bins:
        ranks.append(seen.get(fill, 0))
        seen[fill] = ranks[-1] + past - first
    out = []
    for fill, lo, hi, bin_, each, base in placed:
        at = lo
        while at < hi:  # cut where the final run or the group changes
            b = bin_ + (at - lo) // each
            k = int(np.searchsorted(firsts, b, "right")) - 1
            own = starts[fill]
            g = bisect.bisect_right(own, at, key=lambda x: x[0]) - 1
            to = min(hi, lo + (bins[k][1] - bin_) * each, own[g][1])
            done = last or bins[k][2] >= size - SLACK
            out.append((own[g][2], fill, at - own[g][0], to - own[g][0], parent, b, each, (at - lo) % each, base, done, bins[k][2], ranks[k] + b - bins[k][0]))
            at = to
    return out


def pieces(docs: DataFrame, tokenizer: str, separator: int = 0, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each row's whole text (null: empty) with the separator's id at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, exact = _fast_encoder(tokenizer), own_encoder(tokenizer)
        end = np.array([separator], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py() or ""
                if len(text) >= 20000 and _LONG_SPACE.search(text):
                    ids = next(iter(exact.encode([text]))) + end
                else:
                    ids = np.array(encoder.encode(text, allowed_special="all", disallowed_special=()), "<u4").tobytes() + end
                for k, (s, n) in enumerate(cut(len(ids) // 4, size)):
                    rows.append((doc_id, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.selectExpr(f"cast({id_col} as long) doc_id", f"{text_col} text").mapInArrow(run, _PIECE)


def _pack(rows: pa.Table, group: int, size: int, last: bool) -> pa.Table:
    """The first level of one group: its pieces are the items."""
    length = rows.column("length").to_numpy()
    fills, counts = np.unique(length, return_counts=True)
    runs = plan([(group, int(f), int(n)) for f, n in zip(fills, counts, strict=True)], group, size, last)
    cols = [np.array(c) for c in zip(*sorted(runs, key=lambda r: (r[1], r[2])), strict=True)]
    by = np.argsort(length, kind="stable")
    rank = np.empty(len(length), np.int64)
    rank[by] = np.arange(len(length)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.searchsorted((cols[1].astype(np.int64) << 32) + cols[2], (length << 32) + rank, "right") - 1
    _, _, lo, _, _, bin_, each, skip, base, done, fill_out, rank_out = (c[at] for c in cols)
    k = rank - lo + skip
    new = {
        "sequence_id": (1 << 58) + (group << 34) + bin_ + k // each, "offset": base + k % each * length, "done": done, "group": np.full(len(k), group, np.int64), "fill": fill_out,
        "rank": rank_out + k // each,
    }
    for name, values in new.items():
        rows = rows.append_column(name, pa.array(values))
    return rows


def _packer(size: int, last: bool):
    def run(key, group):
        return _pack(group.drop_columns(["group"]), key[0].as_py(), size, last)

    return run


def _planner(size: int, last: bool):
    def run(key, below):
        runs = plan(list(zip(*(below.column(c).to_pylist() for c in ("group", "fill", "n")), strict=True)), key[0].as_py(), size, last)
        return pa.table([pa.array(c) for c in zip(*runs, strict=True)], names=_RUN_NAMES)

    return run


def pack(items: DataFrame, size: int = SEQUENCE, per_group: int = 40_000) -> DataFrame:
    """items(doc_id, piece, start, length, ids_crc32) with sequence_id and offset; no sequence holds over `size` tokens.

    Repeated rows are items of their own, with null ids too. An empty table gives an empty result. Items are at most `size` long.
    """
    rows = materialize(items.withColumn("row", F.monotonically_increasing_id()))
    groups = max(1, -(-rows.count() // per_group))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups))).drop("row")  # by row, so ids that repeat are no hot group
    cols = [c.split()[0] for c in _PIECE.split(", ")] + ["sequence_id", "offset"]
    packed = materialize(rows.groupBy("group").applyInArrow(_packer(size, groups == 1), _ROW))
    finished, level = [packed.where("done").select(cols)], 1
    while groups > 1:
        groups, level = -(-groups // FAN_IN), level + 1
        open_ = packed.where("NOT done")
        counts = open_.groupBy("group", "fill").agg((F.max("rank") + 1).alias("n"))
        parent = F.floor(F.col("group") / FAN_IN)
        runs = materialize(counts.groupBy(parent.alias("parent")).applyInArrow(_planner(size, groups == 1), _RUN))
        side = narrow_side(runs.select("group", "fill", *(F.col(c).alias(f"r_{c}") for c in _RUN_NAMES[2:])))
        k = F.col("rank") - F.col("r_lo") + F.col("r_skip")
        bin_ = F.floor(k / F.col("r_each"))
        joined = open_.join(side, ["group", "fill"]).where("rank >= r_lo AND rank < r_hi")
        # a bin's number is its level, group and place
        placed = joined.select(
            *cols[:5], (F.lit(level << 58) + F.shiftleft("r_parent", 34) + F.col("r_bin") + bin_).alias("sequence_id"),
            (F.col("offset") + F.col("r_base") + F.pmod(k, F.col("r_each")) * F.col("fill")).alias("offset"), F.col("r_done").alias("done"), F.col("r_parent").alias("group"),
            F.col("r_fill_out").alias("fill"), (F.col("r_rank_out") + bin_).alias("rank"),
        )
        packed = materialize(placed)
        finished.append(packed.where("done").select(cols))
    return functools.reduce(DataFrame.unionByName, finished)


def op10_packing(spark, sf_dir):
    return pack(pieces(table(spark, sf_dir, "documents"), byte_bpe_path()))


QUERIES = {"op10_packing": op10_packing}
ORACLES: dict[str, str] = {}
