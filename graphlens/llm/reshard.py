"""Resharding that moves the fewest bytes: a minimum-cost flow from old shards to new capacities.

The unit is a group of equal texts. Its home is the old shard that holds most of its bytes. The homes' bytes and the new
capacities form a transport problem whose cost is the bytes that change shard. Large groups follow the flows of their home one
by one, largest first; the flow is then solved again for the rest, whose flows become cut points in each home's order of
(text hash, row hash), always between groups. Only a group of over half a shard is split, by rows, since no shard could
take it within its share. Only shards that gain or lose rows are written anew; the rest are read where they are.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, narrow_side, shared_dir, table, text_of

#: A group over capacity / HEAVY is placed alone; there are at most shards * HEAVY of them.
HEAVY = 64
#: A group over this share of a shard is split.
WHOLE = 0.5
#: Bytes of a shard that one task writes, about.
TASK_BYTES = 64 << 20
#: Bits of the histogram in which cut points are looked up first.
BUCKET_BITS = 12
#: Steps into which a large group of equal texts can be cut.
STEPS = 1 << 20


def min_cost_flow(supply: list[int], demand: list[int], cost) -> dict[tuple[int, int], int]:
    """Flows of least cost from all of supply into demand (sums are equal); successive shortest paths on the bipartite graph."""
    left, room, flow = list(supply), list(demand), {}
    n, m = len(supply), len(demand)
    while any(left):
        dist = {("s", i): 0 for i in range(n) if left[i]}
        back: dict = {}
        changed = True
        while changed:  # Bellman-Ford: arcs back have a negative cost
            changed = False
            for i in range(n):
                if ("s", i) in dist:
                    for j in range(m):
                        d = dist["s", i] + cost(i, j)
                        if d < dist.get(("t", j), float("inf")):
                            dist["t", j], back["t", j], changed = d, i, True
            for (i, j), f in flow.items():
                if f and ("t", j) in dist and (d := dist["t", j] - cost(i, j)) < dist.get(("s", i), float("inf")):
                    dist["s", i], back["s", i], changed = d, j, True
        j = min((j for j in range(m) if room[j]), key=lambda j: (dist[("t", j)], j))
        path, at = [], ("t", j)
        while at in back:
            step = back[at]
            path.append((step, at[1], 1) if at[0] == "t" else (at[1], step, -1))
            at = ("s", step) if at[0] == "t" else ("t", step)
        push = min([left[at[1]], room[j], *(flow[a, b] for a, b, sign in path if sign < 0)])
        for a, b, sign in path:
            flow[a, b] = flow.get((a, b), 0) + sign * push
        left[at[1]] -= push
        room[j] -= push
    return {k: f for k, f in flow.items() if f}


def capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def level(room: list[int], total: int) -> list[int]:
    """What each shard takes of total: its room less one level for all (heavy rows may have overfilled some), never below 0."""
    low, high = -total, max(room, default=0)
    while low < high:  # the highest level at which all of total fits
        mid = (low + high + 1) // 2
        low, high = (mid, high) if sum(max(0, r - mid) for r in room) >= total else (low, mid - 1)
    out = [max(0, r - low) for r in room]
    for j in sorted(range(len(out)), key=lambda j: -out[j])[: sum(out) - total]:
        out[j] -= 1
    return out


def _bucket(h: Column) -> Column:
    return F.shiftright(h, 64 - BUCKET_BITS)


def place_heavy(heavy: list[tuple[int, int]], flow: dict[tuple[int, int], int], room: list[int]) -> list[int]:
    """The shards of heavy units (home, size), largest first: along a flow of its home that takes it whole, to stay if that is
    one; else at home if there is room; else where most room is. room is used up."""
    left, out = dict(flow), [0] * len(heavy)
    for k in sorted(range(len(heavy)), key=lambda k: (-heavy[k][1], k)):
        home, size = heavy[k]
        fits = [(j == home, left[i, j], -j) for i, j in left if i == home and left[i, j] >= size and room[j] >= size]
        if fits:
            j = -max(fits)[2]
        elif home < len(room) and room[home] >= size:
            j = home
        else:
            j = max(range(len(room)), key=lambda j: (room[j], -j))
        room[j] -= size
        left[home, j] = left.get((home, j), 0) - size
        out[k] = j
    return out


def plan(rows: DataFrame, shards: int) -> tuple[list[tuple[int, int, int, int]], DataFrame, DataFrame, DataFrame]:
    """(segments, strays, units, split) for rows(size, h, v, old).

    segments: (home, h, v, shard) - rows of that home up to (h, v), after the segment before, go to shard. strays(h, old,
    home): rows whose group has another home. units(h, put): heavy groups. split(h, v, old, put): heavy rows of groups that
    are split. The last two have at most shards * HEAVY rows.
    """
    spark = rows.sparkSession
    held = rows.groupBy("h", "old").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    groups = held.groupBy("h").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.max_by("old", F.struct("bytes", -F.col("old"))).alias("home"), F.collect_list("old").alias("olds"))
    groups = materialize(groups)
    total = int(groups.agg(F.sum("bytes")).first()[0] or 0)
    cap = capacities(total, shards)
    heavy_size = max(1, total // (shards * HEAVY))
    giant = (F.col("bytes") > max(1, int(WHOLE * total / shards))) & (F.col("n") > 1)
    giants = [r[0] for r in groups.where(giant).select("h").collect()]  # at most shards / WHOLE
    strays = materialize(groups.where((F.size("olds") > 1) & ~giant).select("h", F.explode("olds").alias("old"), "home").where("old != home"))
    whole = groups.where((F.col("bytes") > heavy_size) & ~giant).select("h", "home", "bytes").collect()
    parts = rows.where(F.col("h").isin(giants)) if giants else rows.limit(0)
    own = parts.where(F.col("size") > heavy_size).groupBy("h", "v", "old").agg(F.sum("size").alias("bytes")).collect()
    light = groups.where((F.col("bytes") <= heavy_size) & ~giant).select("home", "h", "bytes", F.lit(True).alias("whole"))
    light = light.unionByName(parts.where(F.col("size") <= heavy_size).groupBy(F.col("old").alias("home"), "h").agg(F.sum("size").alias("bytes")).withColumn("whole", F.lit(False)))
    hist: dict[int, dict[int, int]] = {}
    for home, b, size in light.groupBy("home", _bucket(F.col("h")).alias("b")).agg(F.sum("bytes")).collect():
        hist.setdefault(home, {})[int(b)] = int(size)
    heavy = [(r["home"], int(r["bytes"])) for r in whole] + [(r["old"], int(r["bytes"])) for r in own]
    rest = [sum(hist.get(i, {}).values()) for i in range(shards)]
    supply = [x + sum(size for home, size in heavy if home == i) for i, x in enumerate(rest)]
    cost = lambda i, j: int(i != j)
    room = list(cap)
    put = place_heavy(heavy, min_cost_flow(supply, cap, cost), room)
    flow = min_cost_flow(rest, level(room, sum(rest)), cost)
    cuts, order = [], {}
    for i in range(shards):
        ends = sorted((j for a, j in flow if a == i), key=lambda j: (j != i, j))
        order[i], at = ends, 0
        for k, j in enumerate(ends[:-1]):
            at += flow[i, j]
            run = 0
            for b in sorted(hist[i]):
                if run + hist[i][b] >= at:
                    cuts.append((i, b, k, at - run))
                    break
                run += hist[i][b]
    found = {}
    if cuts:
        want = F.broadcast(spark.createDataFrame(cuts, "home int, b long, k int, rest long"))
        near = light.withColumn("b", _bucket(F.col("h")).cast("long")).join(F.broadcast(want.select("home", "b").distinct()), ["home", "b"])
        run = F.sum("bytes").over(Window.partitionBy("home", "b").orderBy("h"))
        hit = near.withColumn("run", run).join(want, ["home", "b"]).where("run >= rest AND run - bytes < rest")
        for r in hit.collect():
            share = (r["rest"] - r["run"] + r["bytes"]) / r["bytes"]
            found[r["home"], r["k"]] = (r["h"], (STEPS if share > 0.5 else 0) if r["whole"] else round(share * STEPS))
    segments = []
    for i, ends in order.items():
        for k, j in enumerate(ends):
            h, v = found.get((i, k), ((1 << 63) - 1, STEPS)) if k < len(ends) - 1 else ((1 << 63) - 1, STEPS)
            segments.append((i, h, v, j))
    units = spark.createDataFrame([(r["h"], j) for r, j in zip(whole, put, strict=False)], "h long, put int")
    split = spark.createDataFrame([(r["h"], r["v"], r["old"], j) for r, j in zip(own, put[len(whole) :], strict=True)], "h long, v long, old int, part int")
    return segments, strays, units, split


def _target(segments) -> Column:
    """The shard of a row (home, h, v) by its home's segments, in order."""
    by: dict[int, list] = {}
    for i, h, v, j in segments:
        by.setdefault(i, []).append((h, v, j))
    out = F.lit(None).cast("int")
    for i, parts in by.items():
        own = F.lit(parts[-1][2])
        for h, v, j in reversed(parts[:-1]):
            own = F.when((F.col("h") < h) | ((F.col("h") == h) & (F.col("v") < v)), j).otherwise(own)
        out = F.when(F.col("home") == i, own).otherwise(out)
    return out


def reshard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs (doc_id, text) with their shard and old_shard; shards that change are rewritten in the shared folder.

    Old shards are the files of docs, in the order of their names, folded into at most `shards` of them; rows that come
    from no file are old shard 0. Sizes of the new shards are near equal, and equal texts share a shard unless they have over
    half of its bytes. A null text has size 1 and stays null; it is a group with the empty ones. Null ids and repeated rows
    are placed like any other. An empty table gives an empty result. Other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    try:
        docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
        files_of = docs
    except AnalysisException:  # rows that come from no Parquet file; once written, each has a place that stays the same
        files_of = None
        docs = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    files = sorted({f.rsplit("/", 1)[-1] for f in (files_of.inputFiles() if files_of is not None else [])})
    known = narrow_side(spark.createDataFrame([(f, i * shards // len(files)) for i, f in enumerate(files)] or [("", 0)], "file string, old int"), max(1, len(files)))
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "file", F.xxhash64("file", "row").alias("place"))
    size = F.octet_length(text_of("text")).cast("long") + 1
    full = kept.withColumn("v", F.pmod(F.xxhash64("place"), F.lit(STEPS)))  # by place, so repeated rows differ
    full = full.join(known, "file", "left").withColumn("old", F.coalesce("old", F.lit(0))).drop("file")
    full = full.withColumns({"size": size, "h": F.xxhash64(text_of("text"))})
    rows = materialize(full.select("size", "h", "v", "old"))
    segments, strays, units, split = plan(rows, shards)
    strays, target = narrow_side(strays), _target(segments)

    def placed(df: DataFrame) -> DataFrame:
        df = df.join(strays, ["h", "old"], "left").withColumn("home", F.coalesce("home", F.col("old")))
        df = df.join(F.broadcast(units), "h", "left").join(F.broadcast(split), ["h", "v", "old"], "left")
        return df.withColumn("shard", F.coalesce("put", "part", target, F.col("old"))).withColumn("old_shard", F.col("old"))

    moves = placed(rows).where("shard != old").groupBy("shard", "old").agg(F.count("*")).collect()
    touched = sorted({x for r in moves for x in (r[0], r[1])})
    total = int(rows.agg(F.sum("size")).first()[0] or 0)
    out = placed(full).select("doc_id", "text", "shard", "old_shard", "place")
    if not touched:
        return out.drop("place")
    changed = F.col("shard").isin(touched) | F.col("old_shard").isin(touched)
    salts = 1 + total // shards // TASK_BYTES
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * shards * salts)
    path = shared_dir(spark)
    salted = out.where(changed).withColumn("s", F.col("shard")).withColumn("salt", F.pmod(F.xxhash64("place", F.lit(1)), F.lit(max(salts, parts // shards))))
    salted.repartition(parts, "shard", "salt").drop("salt", "place").write.option("compression", "zstd").partitionBy("s").parquet(path)
    out = out.drop("place")
    again = spark.read.schema(out.schema).parquet(path).select(out.columns)
    return again.unionByName(out.where(~changed))


def with_slots(rows: DataFrame, rows_per_block: int = 20_000) -> DataFrame:
    """Adds slot, gapless from 0 in each shard: the rows of earlier blocks of the shard, then the place in the block."""
    blocks = rows.groupBy("shard").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    block = F.pmod(F.monotonically_increasing_id(), F.lit(1 + blocks // rows_per_block)).cast("int")
    blocked = materialize(rows.withColumn("block", block))  # rows of a block stay in it
    counts = blocked.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "block", before.alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")) - 1
    return blocked.withColumn("place", place).join(narrow_side(starts), ["shard", "block"]).withColumn("slot", F.col("start") + F.col("place")).drop("block", "place", "start")


def op4_sharding(spark, sf_dir):
    rows = reshard(table(spark, sf_dir, "documents"))
    digest = rows.select("doc_id", (F.octet_length(text_of("text")).cast("long") + 1).alias("size"), F.crc32(text_of("text").cast("binary")).cast("long").alias("text_crc32"), "shard", "old_shard")
    out = with_slots(materialize(digest))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard")


QUERIES = {"op4_sharding": op4_sharding}
ORACLES: dict[str, str] = {}
