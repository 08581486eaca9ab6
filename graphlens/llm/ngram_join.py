"""Near duplicates: an exact Jaccard self-join on sets of word n-grams, by prefix tries, and its components.

Documents of one and the same set (by a 128-bit hash) link to the first of them, which alone goes on. All n-grams have one
global order: rare ones first, by a count sketch of fixed size over all documents, then by hash. Grams are 58 bits of a hash
with a frequency class; they are not compared as words. Two sets that are similar enough share at least `ELL` of the first
grams of each (fewer only if they are tiny), so documents meet by the grams of their prefixes.

Partners are found in two rounds. In the first each gram leads its documents to the least of them, its star, only, and the
links to it give components. In the second the documents of a star that are still in different components meet: their prefixes
are stored as tries, in the global order, and each document outside the star's component walks them. A node stands for all
sets below it: a walk goes to the nodes that carry its grams, passes over a subtree whose sizes or remaining lengths can't
reach the overlap, and counts what is left. So a group of thousands of copies costs a pair for each copy. Tries hold a bounded
number of rows: a star's documents are dealt over size bands and chunks, the walkers over parts, and each part meets the chunks
of fitting sizes.

Candidates are verified on whole sets, in tries too: a walk carries the overlap of shared paths from one set to the next and
skips a subtree as soon as the grams that remain cannot reach the overlap that the sizes below ask for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, narrow_side, table

WORDS = 5
#: Prefix grams that two similar sets share at least.
ELL = 3
#: The sketch has 2**SKETCH_BITS counters, whatever the size of the input.
SKETCH_BITS = 20
#: Grams of candidates in one block of verification, on average at most.
BLOCK_GRAMS = 1 << 18
_BLOCK = 4096
_STEP = 64
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_ROWS = 1 << 16
#: Prefix rows of a trie, and of the documents that walk it in one task, on average at most.
TRIE_ROWS = 1 << 12
#: Size bands are a little wider than the ratio of two similar sets, so these are in neighbouring bands.
BAND = math.log(4 / 3) * 1.0001


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hash = _WordHash()


def gram_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's 5-word shingles; one of all its words if there are fewer, none without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and just the six white spaces
    if not words:
        return np.empty(0, np.uint64)
    if len(_hash) > 1_000_000:
        _hash.clear()
    w = np.fromiter(map(_hash.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for j in range(size):
        h = h * _P + w[j : j + len(h)]
    h ^= h >> np.uint64(31)
    h *= _Q
    h ^= h >> np.uint64(29)
    return np.unique(h)


def ordered(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Grams as numbers in the global order: six bits of frequency class, then the hash."""
    return np.sort(classes[hashes >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(58) | hashes >> np.uint64(6))


def prefix_size(n: int) -> int:
    return min(n, n - -(-3 * n // 4) + ELL)


def least_overlap(a, b):
    """Overlap that sizes a and b need for a similarity of 0.75: 100 * o >= 75 * (a + b - o)."""
    return (3 * (a + b) + 6) // 7


def similar(a: int, b: int, overlap: int) -> bool:
    return 7 * overlap >= 3 * (a + b)


# -- sizes and the sketch ---------------------------------------------------


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("print", pa.binary()), ("block", pa.int32()), ("counts", pa.binary())])
    for batch in batches:
        sizes, prints = [], []
        for text in batch.column(1):
            h = gram_hashes(text.as_py())
            sizes.append(len(h))
            prints.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
            if len(h):
                np.add.at(counts, h >> np.uint64(64 - SKETCH_BITS), 1)
        k = len(batch)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=schema)
    blocks = [(b, counts[b * _BLOCK : (b + 1) * _BLOCK]) for b in range(len(counts) // _BLOCK)]
    blocks = [(b, c.tobytes()) for b, c in blocks if c.any()]
    if blocks:
        yield pa.RecordBatch.from_arrays([pa.nulls(len(blocks), pa.int64()), pa.nulls(len(blocks), pa.int64()), pa.nulls(len(blocks), pa.binary()), pa.array([b for b, _ in blocks], pa.int32()), pa.array([c for _, c in blocks], pa.binary())], schema=schema)


def _sum_blocks(key, group):
    total = np.zeros(_BLOCK, np.int64)
    for c in group.column("counts").to_pylist():
        total += np.frombuffer(c, np.uint32)
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()])})


def _classes(sketch: DataFrame) -> np.ndarray:
    """Frequency class of each counter: twice the binary logarithm of its count."""
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for block, c in sketch.groupBy("block").applyInArrow(_sum_blocks, "block int, counts binary").collect():
        counts[block * _BLOCK : (block + 1) * _BLOCK] = np.frombuffer(bytes(c), np.int64)
    return np.minimum(63, 2 * np.log2(np.maximum(counts, 1))).astype(np.uint8)


# -- prefixes and pairs -----------------------------------------------------


def _prefixes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value
        held, size = [], 0

        def flush():
            grams, docs, ns, sizes = zip(*held, strict=True)
            k = np.array(sizes)
            pos = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            gram = np.concatenate(grams).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(np.repeat(np.array(docs, np.int64), k)), pa.array(pos.astype(np.int32)), pa.array(np.repeat(np.array(ns, np.int32), k))], names=["gram", "doc", "pos", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = gram_hashes(text.as_py())
                if not len(h):
                    continue
                own = ordered(h, classes)[: prefix_size(len(h))]
                held.append((own, doc, len(h), len(own)))
                size += len(own)
                if size >= _ROWS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


_STARRED = ["gram", "doc", "pos", "n", "star", "star_n"]


#: Rows of one gram up to which each is held against the others at once, and beyond which they pass on as they come.
_SMALL, _BIG = 32, 1 << 17


def _partnered(gram, doc, pos, n) -> np.ndarray:
    """Marks rows that have a partner in their gram that fits by size and by place; all rows of grams with many rows."""
    start = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    count = np.diff(np.r_[start, len(gram)])
    keep = np.repeat(count > _SMALL, count)
    live = np.flatnonzero(np.repeat((count > 1) & (count <= _SMALL), count))
    gap = 0
    while len(live):
        gap += 1
        live = live[live + gap < len(gram)]
        live = live[gram[live] == gram[live + gap]]
        a, b = live, live + gap
        na, nb = n[a].astype(np.int64), n[b].astype(np.int64)
        room = ELL - least_overlap(na, nb)
        ok = (doc[a] != doc[b]) & (4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb)) & (pos[a] < na + room) & (pos[b] < nb + room)
        keep[a[ok]] = keep[b[ok]] = True
    return keep


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram and document -> those with a possible partner, and the first such document of their gram, its star."""
    rest = [np.empty(0, t) for t in (np.int64, np.int64, np.int32, np.int32)]
    big = None  # (gram, star, its size) of a gram with so many rows that they pass on unheld

    def of(cols, star=None):
        if star is None:
            keep = _partnered(*cols)
            cols = [c[keep] for c in cols]
            start = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]]) if keep.any() else np.empty(0, np.int64)
            count = np.diff(np.r_[start, len(cols[0])])
            star = [np.repeat(cols[1][start], count), np.repeat(cols[3][start], count)]
        else:
            star = [np.full(len(cols[0]), star[0], np.int64), np.full(len(cols[0]), star[1], np.int32)]
        if len(cols[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*cols, *star)], names=_STARRED)

    for batch in batches:
        cols = [np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, batch.columns, strict=True)]
        if not len(cols[0]):
            continue
        if big is not None:
            more = int(np.searchsorted(cols[0] != big[0], True))
            yield from of([c[:more] for c in cols], big[1:])
            cols = [c[more:] for c in cols]
            if not len(cols[0]):
                rest = cols
                continue
            big = None
        other = np.flatnonzero(cols[0] != cols[0][-1])
        last = other[-1] + 1 if len(other) else 0
        if last:
            yield from of([c[:last] for c in cols])
        rest = [c[last:] for c in cols]
        if len(rest[0]) > _BIG:
            big = (rest[0][0], rest[1][0], rest[3][0])
            yield from of(rest, big[1:])
            rest = [c[:0] for c in rest]
    if len(rest[0]):
        yield from of(rest)


_PAIR = ["a", "b", "na", "nb", "k", "pa", "pb"]
_INT = {"na", "nb", "pa", "pb"}


def _combined(held: list[list[np.ndarray]]) -> pa.RecordBatch:
    """Pairs met by several grams become one row: how many, and the first place in each."""
    a, b, na, nb, p, q = (np.concatenate(c) for c in zip(*held, strict=True))
    by = np.lexsort((b, a))
    a, b, na, nb, p, q = (c[by] for c in (a, b, na, nb, p, q))
    start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    count = np.diff(np.r_[start, len(a)])
    cols = [a[start], b[start], na[start], nb[start], count, np.minimum.reduceat(p, start), np.minimum.reduceat(q, start)]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32 if name in _INT else np.int64)) for name, c in zip(_PAIR, cols, strict=True)], names=_PAIR)


class PrefixTrie:
    """Prefixes of documents, sorted: a node is a gram at a depth with an interval of sets that share the path to it."""

    def __init__(self, gram: np.ndarray, doc: np.ndarray, pos: np.ndarray, n: np.ndarray, comp: np.ndarray, base: np.ndarray):
        """Rows sorted by document and place; base marks documents of the star's component."""
        gram = gram.view(np.uint64)
        start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        size = np.diff(np.r_[start, len(doc)])
        big = gram.astype(">u8")
        order = sorted(range(len(start)), key=lambda k: big[start[k] : start[k] + size[k]].tobytes())
        start, size = start[order], size[order]
        self.doc, self.n, self.comp, self.base = doc[start], n[start].astype(np.int64), comp[start], base[start]
        sets, depths, ends, path, last = [], [], np.empty(len(gram), np.int64), np.empty(0, np.int64), gram[:0]
        made = 0
        for k in range(len(start)):
            own = gram[start[k] : start[k] + size[k]]
            m = min(len(own), len(last))
            differs = np.flatnonzero(own[:m] != last[:m])
            shared = int(differs[0]) if len(differs) else m
            ends[path[shared:]] = k  # the nodes that this set leaves
            new = np.arange(made, made + len(own) - shared)
            sets.append(np.full(len(new), k))
            depths.append(np.arange(shared, len(own)))
            path, last, made = np.concatenate([path[:shared], new]), own, made + len(new)
        ends[path] = len(start)
        lo, depth = np.concatenate(sets), np.concatenate(depths)
        node_gram = gram[start[lo] + depth]
        by = np.argsort(node_gram, kind="stable")
        lo, depth, self.gram = lo[by], depth[by], node_gram[by]
        self.count = ends[:made][by] - lo
        self.first = np.cumsum(self.count) - self.count
        #: The sets below each node, and the node's place in each.
        self.below = np.arange(self.count.sum()) - np.repeat(self.first - lo, self.count)
        self.place = pos[start[self.below] + np.repeat(depth, self.count)].astype(np.int64)
        sizes = self.n[self.below]
        self.least, self.most, self.early = np.minimum.reduceat(sizes, self.first), np.maximum.reduceat(sizes, self.first), np.minimum.reduceat(self.place, self.first)

    def walk(self, gram, doc, pos, n, comp) -> Iterator[list[np.ndarray]]:
        """Rows of walking documents -> a, b, na, nb, place in a, place in b of each gram that a walker shares with a set it may link to."""
        gram, n, pos = gram.view(np.uint64), n.astype(np.int64), pos.astype(np.int64)
        lo, hi = np.searchsorted(self.gram, gram), np.searchsorted(self.gram, gram, "right")
        row = np.repeat(np.arange(len(gram)), hi - lo)
        node = np.arange(len(row)) - np.repeat(np.cumsum(hi - lo) - hi, hi - lo)
        na = n[row]
        least, most = np.maximum(self.least[node], -(-3 * na // 4)), np.minimum(self.most[node], 4 * na // 3)
        fits = (least <= most) & (pos[row] < na + ELL - least_overlap(na, least)) & (self.early[node] < most + ELL - least_overlap(na, most))
        row, node = row[fits], node[fits]
        ends = np.cumsum(self.count[node])
        at = 0
        while at < len(row):  # some subtrees at a time
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 16 * _ROWS, "right")))
            count = self.count[node[at:to]]
            r = np.repeat(row[at:to], count)
            k = np.arange(len(r)) - np.repeat(np.cumsum(count) - count - self.first[node[at:to]], count)
            s, q = self.below[k], self.place[k]
            na, nb = n[r], self.n[s]
            room = ELL - least_overlap(na, nb)
            ok = (4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb)) & (pos[r] < na + room) & (q < nb + room) & (comp[r] != self.comp[s]) & (self.base[s] | (doc[r] < self.doc[s]))
            r, s, q = r[ok], s[ok], q[ok]
            if len(r):
                swap = doc[r] > self.doc[s]
                pair = lambda x, y: [np.where(swap, y, x), np.where(swap, x, y)]  # noqa: B023, E731
                yield [*pair(doc[r], self.doc[s]), *pair(n[r], self.n[s]), *pair(pos[r], q)]
            at = to


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (star, band, chunk, part, walks, gram, doc, pos, n, comp, base), sorted: of each block the trie's rows, then the walkers'."""
    at, rows, trie = None, [], None
    held: list[list[np.ndarray]] = []
    size = 0

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        cuts = np.flatnonzero(np.r_[True, *[np.any([c[1:] != c[:-1] for c in cols[:5]], axis=0)]])
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(cols[0])], strict=True):
            key, walks = tuple(c[lo] for c in cols[:4]), cols[4][lo]
            if key != at:
                at, rows, trie = key, [], None
            own = [c[lo:hi] for c in cols[5:]]
            if not walks:
                rows.append(own)
                continue
            if trie is None:
                if not rows:
                    continue
                trie, rows = PrefixTrie(*(np.concatenate(c) for c in zip(*rows, strict=True))), []
            for pairs in trie.walk(*own[:5]):
                held.append(pairs)
                size += len(pairs[0])
                if size > 16 * _ROWS:
                    yield _combined(held)
                    held.clear()
                    size = 0
    if held:
        yield _combined(held)


def meetings(joined: DataFrame, parts: int) -> DataFrame:
    """joined(gram, doc, pos, n, comp, star) -> pairs(a, b, na, nb, k, pa, pb) that share k grams of their prefixes and are in
    different components; pa and pb are the first places of these."""
    joined = joined.withColumn("band", F.floor(F.log("n") / BAND).cast("int"))
    stars = joined.groupBy("star").agg(F.max(F.when(F.col("doc") == F.col("star"), F.col("comp"))).alias("own"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi")
    stars = materialize(stars.select("star", "own"))
    rows = materialize(joined.join(narrow_side(stars), "star").withColumn("base", F.col("comp") == F.col("own")))
    near = rows.where("NOT base").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    some = lambda df, name: df.groupBy("star", "band").agg(F.ceil(F.count("*") / TRIE_ROWS).cast("int").alias(name))
    blocks = narrow_side(materialize(some(rows, "chunks").join(some(near, "parts"), ["star", "band"])))
    deal = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["star", "band", "chunk", "part", "walks", "gram", "doc", "pos", "n", "comp", "base"]
    stored = rows.join(blocks, ["star", "band"]).withColumns({"chunk": deal("chunks"), "part": every("parts"), "walks": F.lit(False)})
    near = near.join(blocks, ["star", "band"]).withColumns({"chunk": every("chunks"), "part": deal("parts"), "walks": F.lit(True)})
    both = stored.select(cols).unionByName(near.select(cols)).repartition(parts, "star", "band", "chunk", "part")
    found = both.sortWithinPartitions("star", "band", "chunk", "part", "walks", "doc", "pos").mapInArrow(_walks, "a long, b long, na int, nb int, k long, pa int, pb int")
    return found.groupBy("a", "b", "na", "nb").agg(F.sum("k").alias("k"), F.min("pa").alias("pa"), F.min("pb").alias("pb"))


# -- verification -----------------------------------------------------------


class Trie:
    """Sets in the global order, sorted: shared paths are neighbours, and `shared[k]` is how much of set k-1's path set k shares."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u8").tobytes())
        self.sets = [sets[k] for k in self.order]
        self.sizes = np.array([len(x) for x in self.sets], np.int64)
        shared = [0]
        for x, y in zip(self.sets, self.sets[1:], strict=False):
            m = min(len(x), len(y))
            differs = np.flatnonzero(x[:m] != y[:m])
            shared.append(int(differs[0]) if len(differs) else m)
        self.shared = np.array(shared, np.int64)

    def overlapping(self, probe: np.ndarray) -> list[int]:
        """Numbers of the sets that are similar to the probe."""
        found, a, k = [], len(probe), 0
        run = np.zeros(1, np.int64)  # overlaps of the last path's first 0, 1, ... grams, as far as it was walked
        while k < len(self.sets):
            own = self.sets[k]
            b, need = len(own), int(least_overlap(a, len(own)))
            run = run[: min(int(self.shared[k]), len(run) - 1) + 1]
            while (depth := len(run) - 1) < b:
                seen = int(np.searchsorted(probe, own[depth]))
                if run[-1] + min(b - depth, a - seen) < need:
                    break
                part = own[depth : depth + _STEP]
                at = np.minimum(np.searchsorted(probe, part), a - 1)
                run = np.concatenate([run, run[-1] + np.cumsum(probe[at] == part)])
            else:
                if similar(a, b, int(run[-1])):
                    found.append(self.order[k])
                k += 1
                continue
            # no set below this node can reach its overlap, from the largest to the smallest: on behind them
            leaves = np.flatnonzero(self.shared[k + 1 :] <= depth)
            end = k + 1 + (int(leaves[0]) if len(leaves) else len(self.sets) - k - 1)
            below = self.sizes[k + 1 : end]
            if len(below) and run[-1] + min(int(below.max()) - depth, a - seen) < least_overlap(a, int(below.min())):
                k = end
            else:
                k += 1
        return found


def _verify(shared):
    """Rows (a, chunk, doc, text) sorted by a, chunk; the row whose doc is a is the probe -> links (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value
        at, probe, docs, sets = None, [], [], []

        def close():
            trie = Trie(sets)
            hits = sorted({k for p in probe for k in trie.overlapping(p)})
            return [(at[0], docs[k]) for k in hits]

        for batch in batches:
            out = []
            for a, chunk, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if (a, chunk) != at:
                    if probe and sets:
                        out += close()
                    at, probe, docs, sets = (a, chunk), [], [], []
                own = ordered(gram_hashes(text.as_py()), classes)
                if not len(own):
                    continue
                if doc == a:
                    probe.append(own)
                else:
                    docs.append(doc)
                    sets.append(own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["u", "v"])
        if probe and sets and (out := close()):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["u", "v"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, shared, parts: int) -> DataFrame:
    """Links (u, v) among pairs(a, b, nb) of texts(doc, text)."""
    pairs = materialize(pairs)
    load = pairs.groupBy("a").agg(F.ceil(F.sum("nb") / BLOCK_GRAMS).cast("int").alias("chunks"))
    placed = pairs.join(narrow_side(load), "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), F.col("b").alias("doc"))
    members = placed.unionByName(placed.select("a", "chunk").distinct().withColumn("doc", F.col("a")))
    blocks = members.join(texts, "doc").select("a", "chunk", "doc", "text").repartition(parts, "a", "chunk").sortWithinPartitions("a", "chunk")
    return materialize(blocks.mapInArrow(_verify(shared), "u long, v long"))


def components(links: DataFrame) -> DataFrame:
    """links(u, v) -> doc, component: the least document that links reach; only documents with links have a row.

    Each round takes the least label of the neighbours and then that label's own label, until nothing changes.
    """
    both = materialize(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u != v").distinct())
    labels = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("c")))
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("m"))
        least = labels.join(near, "u").select("u", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jump = labels.select(F.col("u").alias("c"), F.col("c").alias("far"))
        new = materialize(least.join(jump, "c", "left").select("u", "old", F.coalesce("far", "c").alias("c")))
        if not new.where("c != old").limit(1).count():
            return new.select(F.col("u").alias("doc"), F.col("c").alias("component"))
        labels = new.select("u", "c")


def apart(rows: DataFrame, several: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(doc_id, text) with a number of its own for each text of the ids in several, and names(doc_id, name): those numbers'
    ids. The numbers are hashes of id and text; repeated rows stay one."""
    known = rows.join(narrow_side(several.withColumn("known", F.lit(True))), "doc_id", "left")
    number = F.when(F.col("known"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))
    names = materialize(known.where("known").select(number.alias("doc_id"), F.col("doc_id").alias("name")).distinct())
    return known.select(number.alias("doc_id"), "text"), names


def by_name(links: DataFrame, names: DataFrame | None) -> DataFrame:
    """links(u, v) between documents, from links between their texts."""
    if names is None:
        return links
    for end in ("u", "v"):
        links = links.join(narrow_side(names.select(F.col("doc_id").alias(end), F.col("name"))), end, "left").withColumn(end, F.coalesce("name", end)).drop("name")
    return links.select("u", "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs.

    Texts without words (null, empty) have no grams, link with nothing and are their own component. Rows that share an id
    are one document, linked by either text. A null id is not linked and keeps a null component. An empty table gives an
    empty result. Other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    measure = lambda df: materialize(df.mapInArrow(_measure, "doc_id long, n long, print binary, block int, counts binary"))
    measured = measure(rows)
    shared = spark.sparkContext.broadcast(_classes(measured.where("block IS NOT NULL").select("block", "counts")))
    sets = measured.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("print").alias("print"), F.max("print").alias("other"))
    several = materialize(sets.where("print != other").select("doc_id"))
    sets, names = sets.where("print = other").select("doc_id", "print"), None
    if several.limit(1).count():
        rows, names = apart(rows, several)
        sets = sets.unionByName(measure(rows.join(narrow_side(names.select("doc_id")), "doc_id", "left_semi")).where("n > 0").select("doc_id", "print"))
    first = sets.groupBy("print").agg(F.min("doc_id").alias("v"), F.count("*").alias("k")).where("k > 1").select("print", "v")
    copies = materialize(sets.join(narrow_side(materialize(first)), "print").where("doc_id != v").select(F.col("doc_id").alias("u"), "v").distinct())
    named = rows.where("doc_id IS NOT NULL").join(narrow_side(copies.select(F.col("u").alias("doc_id"))), "doc_id", "left_anti")
    grams = named.mapInArrow(_prefixes(shared), "gram long, doc long, pos int, n int")
    postings = materialize(grams.repartition(parts, "gram").sortWithinPartitions("gram", "doc").mapInArrow(_stars, "gram long, doc long, pos int, n int, star long, star_n int"))
    seen = postings.groupBy("doc").agg(F.count("*").alias("k"), F.first("n").alias("n")).where(F.col("k") >= F.least(F.lit(ELL), F.ceil(F.col("n") * 3 / 4)))
    active = materialize(seen.select(F.col("doc").alias("doc_id")))
    texts = materialize(named.join(narrow_side(active), "doc_id", "left_semi").withColumnRenamed("doc_id", "doc"))

    need = F.floor((3 * (F.col("na") + F.col("nb")) + 6) / 7)
    stars = postings.where("doc != star AND 4 * least(n, star_n) >= 3 * greatest(n, star_n)")
    stars = stars.groupBy(F.col("star").alias("a"), F.col("doc").alias("b"), F.col("star_n").alias("na"), F.col("n").alias("nb")).agg(F.count("*").alias("k"))
    links = verified(stars.where(F.col("k") >= F.least(F.lit(ELL), need)).select("a", "b", "nb"), texts, shared, parts)
    links = links.unionByName(copies)
    found = components(by_name(links, names))
    placed = found
    if names is not None:
        own = names.select(F.col("doc_id").alias("doc"), F.col("name")).join(found.withColumnRenamed("doc", "name"), "name", "left").select("doc", F.coalesce("component", "name").alias("component"))
        placed = materialize(found.unionByName(own))

    joined = postings.join(narrow_side(placed), "doc", "left").select("gram", "doc", "pos", "n", F.coalesce("component", "doc").alias("comp"), "star")
    crossing = meetings(joined, parts)
    reach = 1 + F.least(F.col("na") - 1 - F.col("pa"), F.col("nb") - 1 - F.col("pb"))
    crossing = crossing.where((F.col("k") >= F.least(F.lit(ELL), need)) & (reach >= need)).select("a", "b", "nb")
    more = verified(crossing, texts, shared, parts)
    if more.limit(1).count():
        found = components(by_name(links.unionByName(more), names))
    sizes = measured.where("block IS NULL").select("doc_id", F.col("n").alias("n_shingles"))
    out = sizes.join(narrow_side(found.withColumnRenamed("doc", "doc_id")), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, without those whose component has a smaller document."""
    gone = near_duplicates(docs, id_col, text_col).where("component_id < doc_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(narrow_side(materialize(gone), limit=BROADCAST_ROWS), id_col, "left_anti").select(docs.columns)


def op7_ngram_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op7_ngram_join": op7_ngram_join}
ORACLES = {
    "op7_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
n AS (SELECT doc_id, len(g) AS n FROM s), u AS (SELECT doc_id, unnest(g) AS g FROM s),
k AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM k JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other)
SELECT r.doc_id, any_value(n.n) AS n_shingles, min(r.other) AS component_id FROM r JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
""",
}
