"""Exact duplicates by an extendible-hash index kept on shared files.

Every row's normalised text has a 64-bit key. A directory over the key's leading bits doubles until no bucket that can be
split holds more than `capacity` distinct texts; each bucket is a key range with one owner task. Directory and index are
tables in the shared folder, the index sorted by bucket and key. Keys that occur more than once have their texts sent to the
owners (copies are merged in each task before the shuffle, so a text with very many copies is sent a few times only); an owner
walks its key range, chains the different texts of one key and compares bytes along the chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialize, narrow_side, table, text_of

#: Bits of the directory beyond those that equal buckets would need.
SPARE_BITS = 3
#: Bytes of texts that a task merges before it passes them on.
MERGE_BYTES = 32 << 20


def normalised(text):
    return F.regexp_replace(text_of(text), SPACES, " ")


def prefix_of(key, depth: int):
    """The leading bits of a signed 64-bit key, in the order of the unsigned key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def double_directory(index: DataFrame, capacity: int, bits: int) -> tuple[DataFrame, int]:
    """The directory over index(key), pointer, bucket, depth for each prefix of `bits` bits that occurs, and its bits.

    A bucket as deep as d holds the keys with its d leading bits; it splits while it is overfull, so a pointer's bucket is the
    first depth at which the texts below are at most `capacity`. Its number is its first pointer. A bucket that is still
    overfull at the last bit gives the directory more bits, unless all its texts have one key: these make an overflow chain.
    """
    while True:
        key = F.col("key")
        fine = materialize(index.groupBy(prefix_of(key, bits).alias("pointer")).agg(F.count("*").alias("n"), (F.min("key") != F.max("key")).alias("many")))
        depths = fine.select("pointer", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
        at = depths.withColumn("first", F.expr(f"pointer - pmod(pointer, shiftleft(1L, {bits} - depth))"))
        fits = at.groupBy("depth", "first").agg(F.sum("n").alias("inside")).where(F.col("inside") <= capacity)
        leaf = at.join(narrow_side(materialize(fits)), ["depth", "first"]).groupBy("pointer").agg(F.min(F.struct("depth", "first")).alias("leaf"))
        out = materialize(fine.join(leaf, "pointer", "left").select("pointer", F.coalesce("leaf.first", "pointer").alias("bucket"), F.coalesce("leaf.depth", F.lit(bits)).alias("depth"), (F.col("leaf").isNull() & F.col("many")).alias("over")))
        if bits >= 60 or not out.where("over").limit(1).count():
            return out.drop("over"), bits
        bits = min(60, bits + 4)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies inside one task become one row with the smallest id and the count."""
    held: dict[tuple[int, bytes], list] = {}
    size = 0

    def flush():
        return _rows([(k[0], k[1], v[0], v[1], v[2]) for k, v in held.items()])

    for batch in batches:
        for bucket, key, text, doc_id in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            at = held.get((key, text))
            if at is None:
                held[key, text] = [bucket, doc_id, 1]
                size += len(text) + 100
            else:
                at[1] = doc_id if at[1] is None else at[1] if doc_id is None else min(at[1], doc_id)
                at[2] += 1
        if size > MERGE_BYTES:
            yield flush()
            held.clear()
            size = 0
    if held:
        yield flush()


_MERGED = pa.schema([("key", pa.int64()), ("text", pa.binary()), ("bucket", pa.int64()), ("head", pa.int64()), ("copies", pa.int64())])


def _rows(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _MERGED, strict=True)], schema=_MERGED)


_OWNED = pa.schema([("key", pa.int64()), ("sha", pa.string()), ("head", pa.int64()), ("copies", pa.int64()), ("chain", pa.int32())])


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's pass over its sorted key range: a chain of different texts for the key at hand."""
    at, chain, out = None, [], []

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _OWNED, strict=True)], schema=_OWNED)

    for batch in batches:
        for key, text, head, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if key != at:
                out += [(at, hashlib.sha256(link[0]).hexdigest(), link[1], link[2], len(chain)) for link in chain]
                at, chain = key, []
            for link in chain:
                if link[0] == text:  # bytes
                    link[1] = head if link[1] is None else link[1] if head is None else min(link[1], head)
                    link[2] += n
                    break
            else:
                chain.append([text, head, n])
        if out:
            yield flush()
            out = []
    out += [(at, hashlib.sha256(link[0]).hexdigest(), link[1], link[2], len(chain)) for link in chain]
    if out:
        yield flush()


def exact_duplicates(docs: DataFrame, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, bucket (of the index).

    Texts are equal when they are after each run of white space became one space. The row with the smallest id of equal
    texts stays. A null text counts as empty; null ids lose against any id (a group with null ids only keeps null);
    repeated rows with one id and one text are all marked as kept. An empty table gives an empty result; other columns of docs are not looked at.
    `capacity` is the size of a bucket in distinct texts; the directory's depth follows from how many there are.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text_col).alias("text"))
    entries = materialize(rows.select("doc_id", F.xxhash64("text").alias("key"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")))
    index = materialize(entries.groupBy("key", "sha").agg(F.min("doc_id").alias("head"), F.count("*").alias("copies")))
    bits = max(1, (index.count() // capacity).bit_length() + SPARE_BITS)
    directory, bits = double_directory(index, capacity, bits)
    pointer = prefix_of(F.col("key"), bits).alias("pointer")
    pointers = narrow_side(directory.select("pointer", "bucket"))
    owners = max(1, min(directory.select("bucket").distinct().count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    placed = index.select("*", pointer).join(pointers, "pointer").drop("pointer")
    index = materialize(placed.repartition(owners, "bucket").sortWithinPartitions("bucket", "key"))
    again = index.groupBy("bucket", "key").agg(F.sum("copies").alias("n")).where("n > 1").select("bucket", "key")
    texts = rows.withColumn("key", F.xxhash64("text")).join(narrow_side(again), "key").select("bucket", "key", F.col("text").cast("binary").alias("text"), "doc_id")
    merged = texts.mapInArrow(_merge, "key long, text binary, bucket long, head long, copies long")
    owned = merged.repartition(owners, "bucket").sortWithinPartitions("bucket", "key").select("key", "text", "head", "copies")
    groups = materialize(owned.mapInArrow(_own, "key long, sha string, head long, copies long, chain int"))
    out = entries.join(narrow_side(groups.select("key", "sha", "head", "copies")), ["key", "sha"], "left").select("*", pointer).join(pointers, "pointer")
    keep = F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("head"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"), "bucket")


def op2_exact_dedup(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("bucket")


QUERIES = {"op2_exact_dedup": op2_exact_dedup}
ORACLES = {
    "op2_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(n) AS text_sha256
FROM t WINDOW w AS (PARTITION BY n)
""",
}
