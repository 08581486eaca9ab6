"""WARC archives with one gzip member a record, and a boundary chain that keeps payloads from posing as records.

Writing: a record is a header block, an empty line and the payload, and ends with an empty line. Each record is a gzip member
of its own, so any WARC reader can start at one; Spark's text sink writes the members, and files are named .warc.gz. Equal
payloads are written once; the others revisit that record. Files end after about a fixed number of plain bytes.

Reading: files are split anywhere (compressed ones are one split each); offsets are those of the plain bytes. Tasks cut their
splits at CR LF CR LF and report, for each piece that starts like a record, its offset and the offset its Content-Length points
to. Payloads can hold the same magic, so only what is reached from a file's start counts: pointer jumping doubles the length of
the links each round, and a chain of n records takes log2 n rounds. Payloads are put together by ranges of a file's bytes, so a
large file is the work of many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize, narrow_side, shared_dir, table, text_of

CRLF = "\r\n"
BREAK = CRLF * 2
#: Plain bytes of a file, about; and bytes of a file that one task puts together when it is read.
FILE_BYTES = 64 << 20
RANGE_BYTES = 32 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A member of less plain bytes ends with a zero byte, the last of its size field.
_MEMBER = (1 << 24) - 1
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_MAGIC = "^[\\r\\n]*WARC/1\\.[01]\\r\\n"


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: every 5 hex digits are 4 letters."""

    def letters(h: Column) -> Column:
        out = []
        for k in range(8):
            n = F.conv(F.substring(h, 5 * k + 1, 5), 16, 10).cast("int")
            out += [F.substring(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
        return F.concat(*out)

    return let(F.sha1(data), letters)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record as a gzip member without its last byte, a zero that the text sink adds as its separator.

    A record too large for that has several members, which read as one.
    """
    for batch in batches:
        out = []
        for record in batch.column(0):
            data, parts = memoryview(record.as_buffer()), []
            for at in range(0, len(data), _MEMBER):
                own = zlib.compressobj(3, zlib.DEFLATED, 31)
                parts += [own.compress(data[at : at + _MEMBER]), own.flush()]
            out.append(b"".join(parts)[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def _rename(spark, path: str, old: str, new: str) -> None:
    """Gives the files below path another ending; the codec is known by it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.listStatus(folder):
        name = found.getPath().getName()
        if name.endswith(old):
            fs.rename(found.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, name[: -len(old)] + new))


def _with_first(rows: DataFrame, min_bytes: int) -> DataFrame:
    """rows(page_id, url, html) with digest, again (not the first of its payload) and refers_to.

    The first is the row with the smallest id, null ids last; of rows with that id and payload it is any one.
    """
    rows = rows.withColumns({"bytes": F.octet_length("html").cast("long"), "digest": sha1_base32(F.col("html").cast("binary"))})
    seen = rows.where(F.col("bytes") >= min_bytes).groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    order = F.struct(F.col("page_id").isNull(), "page_id")
    first = seen.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.sum("n").alias("all"), F.min_by("n", order).alias("ties")).where(F.col("all") > 1)
    first = materialize(first.drop("all"))
    tied = F.coalesce((F.col("ties") > 1) & F.col("page_id").eqNullSafe(F.col("refers_to")), F.lit(False))
    known = rows.join(narrow_side(first), "digest", "left")
    again = F.col("ties").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    out = known.where(~tied).withColumn("again", again)
    if first.where("ties > 1").limit(1).count():
        copies = materialize(known.where(tied).withColumn("row", F.monotonically_increasing_id()))
        one = copies.groupBy("digest").agg(F.min("row").alias("one"))
        copies = copies.join(narrow_side(materialize(one)), "digest").withColumn("again", F.col("row") != F.col("one"))
        out = out.unionByName(copies.select(out.columns))
    return out.withColumn("alone", F.col("ties").isNull()).drop("ties", "bytes")


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, date: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes one record per row of pages below path. Of equal payloads of at least min_bytes, the smallest id is the response.

    A null html is an empty payload, a null url an empty one. Rows may repeat and ids may be null, negative or repeated: a
    payload has one response, the other rows with it are revisits, whatever their ids. Null ids are larger than any other.
    An empty table gives an archive without records. Other columns are not looked at. `date` is that of all records, now if
    not given; texts of any length are written, those over 16 MB as several members of one record.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), text_of(url_col).alias("url"), text_of(html_col).alias("html"))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("html").cast("long")).alias("bytes")).first()
    full = _with_first(rows, min_bytes)
    again = F.col("again")
    payload = F.when(again, F.lit("")).otherwise(F.col("html"))
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def line(name: str, value) -> Column:
        return F.concat(F.lit(f"{CRLF}{name}: "), F.coalesce(value.cast("string"), F.lit("")))

    def name(page_id: str, *more) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.lit(":"), F.col("digest"), *more, F.lit(">"))

    url = F.regexp_replace("url", "[\\r\\n]", "")
    own = F.when(again | F.col("alone"), name("page_id", F.lit(":"), F.uuid())).otherwise(name("page_id"))
    record = F.concat(
        F.lit("WARC/1.1"), line("WARC-Type", F.when(again, "revisit").otherwise("response")), line("WARC-Record-ID", own), line("WARC-Date", F.lit(date) if date else now),
        line("WARC-Target-URI", url), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Profile", F.lit(REVISIT)), line("WARC-Refers-To", name("refers_to")))).otherwise(line("Content-Type", F.lit("text/html"))),
        line("Content-Length", F.octet_length(payload)), F.lit(BREAK), payload, F.lit(BREAK),
    )
    per_file = max(1, int(FILE_BYTES / ((size["bytes"] or 0) / max(1, size["n"]) + 500)))
    members = full.select(record.cast("binary").alias("value")).mapInArrow(_members, "value binary")
    members.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", per_file).text(path)
    _rename(spark, path, ".txt", ".warc.gz")


def _field(name: str) -> Column:
    return F.regexp_extract("head", f"(?i)\\r\\n{name}:[ \\t]*([^\\r\\n]*)", 1)


def _run_offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a split come in order: adds each one's offset in its split."""
    at, run = None, 0
    for batch in batches:
        key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        size = batch.column(2).to_numpy() + len(BREAK)
        if not len(size):
            continue
        start = np.flatnonzero(np.r_[True, (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])])
        total = np.cumsum(size)
        before = np.repeat((total - size)[start], np.diff(np.r_[start, len(size)]))
        offset = total - size - before
        if (key[0][0], key[1][0]) == at:
            offset[: start[1] if len(start) > 1 else len(size)] += run
        at, run = (key[0][-1], key[1][-1]), int(offset[-1] + size[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(offset)], names=[*batch.schema.names, "offset"])


def _pieces(spark, path: str, name: str, column: Column) -> DataFrame:
    """The pieces between empty lines: file (a hash of its path), split, len, one more column, offset in the split."""
    raw = spark.read.option("lineSep", BREAK).text(path)
    own = raw.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.octet_length("value").cast("long").alias("len"), column.alias(name))
    kind = own.schema[name].dataType.simpleString()
    return own.mapInArrow(_run_offsets, f"file long, split long, len long, {name} {kind}, offset long")


def reachable(links: DataFrame) -> DataFrame:
    """links(file, at, next): the rows that a chain from the file's first candidate at offset 0 reaches, by pointer jumping."""
    jump = materialize(links.select("file", "at", "next"))
    nodes = jump.select("file", "at")
    found = nodes.where("at = 0")
    while True:
        hop = jump.join(found, ["file", "at"], "left_semi").select("file", F.col("next").alias("at"))
        grown = materialize(found.union(hop.join(nodes, ["file", "at"], "left_semi")).distinct())
        far = jump.select("file", F.col("at").alias("next"), F.col("next").alias("far"))
        jump = materialize(jump.join(far, ["file", "next"]).select("file", "at", F.col("far").alias("next")))
        done = grown.count() == found.count()
        found = grown
        if done:
            return found


def read_warc(spark, path: str) -> DataFrame:
    """The records below path: file (a hash of its path), at, record_type, page_id, url, refers_to, declared digest, payload (bytes).

    Only records that the chain from the file's start reaches are returned; text inside payloads that looks like a record
    is not. A chain that breaks (a wrong Content-Length) ends there. Record names that write_warc didn't give have no
    page_id. No files, no rows.
    """
    narrow = materialize(_pieces(spark, path, "head", F.when(F.col("value").rlike(_MAGIC), F.col("value"))))
    ends = narrow.groupBy("file", "split").agg(F.max(F.col("offset") + F.col("len") + len(BREAK)).alias("bytes"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(ends.select("file", "split", "bytes", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base")))
    total = bases.agg(F.sum("bytes")).first()[0] or 0
    bases = narrow_side(bases.drop("bytes"))
    placed = lambda df: df.join(bases, ["file", "split"]).withColumn("at", F.col("base") + F.col("offset"))
    starts = placed(narrow.where("head IS NOT NULL")).withColumn("lead", F.regexp_extract("head", "^[\\r\\n]*", 0))
    lead = F.length("lead")
    body = F.col("at") + F.col("len") + len(BREAK)
    page = lambda field: F.regexp_extract(_field(field), "^<urn:page:(-?\\d+):", 1).try_cast("long")
    links = starts.select(
        "file", (F.col("at") + lead).alias("at"), body.alias("body"), (body + _field("Content-Length").try_cast("long")).alias("end"), _field("WARC-Type").alias("record_type"),
        page("WARC-Record-ID").alias("page_id"), _field("WARC-Target-URI").alias("url"), page("WARC-Refers-To").alias("refers_to"), F.regexp_extract(_field("WARC-Payload-Digest"), "sha1:(.*)", 1).alias("digest"),
    )
    links = materialize(links.where("end IS NOT NULL"))
    records = materialize(links.join(reachable(links.withColumn("next", F.col("end") + len(BREAK))), ["file", "at"], "left_semi"))
    fields = [c for c in records.columns if c != "file"]
    # a piece belongs to the range in which its record begins
    over = lambda c: F.floor(F.col(c) / RANGE_BYTES)
    marks = records.select("file", F.col("body").alias("at"), over("body").alias("range"), F.struct(*fields).alias("record"))
    wide = records.withColumn("first", over("body")).withColumn("last", F.floor((F.col("end") - 1) / RANGE_BYTES)).where("last > first")
    wide = wide.select("file", F.explode(F.sequence(F.col("first") + 1, F.col("last"))).alias("range"), F.col("end").alias("until"), F.col("first").alias("back"))
    pieces = placed(_pieces(spark, path, "value", F.col("value").cast("binary"))).select("file", "at", "value", over("at").alias("range"))
    pieces = pieces.join(narrow_side(materialize(wide)), ["file", "range"], "left").withColumn("range", F.when(F.col("at") < F.col("until"), F.col("back")).otherwise(F.col("range")))
    both = pieces.select("file", "at", "value", "range").unionByName(marks, allowMissingColumns=True)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (2 * RANGE_BYTES))
    both = both.repartition(parts, "file", "range")
    owner = F.last("record", ignorenulls=True).over(Window.partitionBy("file", "range").orderBy("at", F.col("value").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    inside = both.withColumn("record", owner).where("value IS NULL OR at < record.end")
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("at", "value")))), lambda x: x["value"])
    sep = F.lit(BREAK.encode())
    joined = F.aggregate(parts, F.lit(None).cast("binary"), lambda a, x: F.when(a.isNull(), x).otherwise(F.concat(a, sep, x)))
    size = (F.col("record.end") - F.col("record.body")).cast("int")
    grouped = inside.groupBy("file", "range", "record.at").agg(F.first("record", ignorenulls=True).alias("record"), joined.alias("joined"))
    return grouped.withColumn("payload", F.coalesce(F.substring(F.rpad("joined", size, sep), F.lit(1), size), F.lit(b""))).select("file", "record.*", "payload").drop("body", "end")


def op6_warc(spark, sf_dir):
    path = shared_dir(spark)
    write_warc(table(spark, sf_dir, "pages"), path)
    read = read_warc(spark, path)
    digest = materialize(read.select("page_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("payload_bytes"), sha1_base32(F.col("payload")).alias("payload_digest")))
    again = digest.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "digest")
    referred = again.select("digest").distinct()
    whole = digest.where("record_type = 'response'").select(F.col("payload_digest").alias("digest"), "payload_bytes", "payload_digest").join(referred, "digest", "left_semi")
    revisits = again.join(narrow_side(materialize(whole)), "digest")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return digest.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(cols).unionByName(revisits.select(cols))


_HEX5 = "('0x' || substr(h, 5 * k::INT + 1, 5))::BIGINT"
_LETTERS = " || ".join(f"substr('{BASE32}', ((x >> {s}) & 31)::INT + 1, 1)" for s in (15, 10, 5, 0))


QUERIES = {"op6_warc": op6_warc}
ORACLES = {
    "op6_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, array_to_string(list_transform(list_transform(range(8), lambda k: {_HEX5}), lambda x: {_LETTERS}), '') AS payload_digest,
 min(page_id) OVER (PARTITION BY h) AS least, row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST) AS rn FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN rn = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN rn > 1 THEN least END AS refers_to FROM d
""",
}
