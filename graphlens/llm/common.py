"""Shared folder, word classes and join helpers of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import materialize, shared_dir  # noqa: F401

#: The white space that separates words: space and U+0009 to U+000D.
SPACES = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
#: A side of a join is broadcast up to so many rows (narrow rows of a few numbers); beyond that it is shuffled.
BROADCAST_ROWS = 200_000


def narrow_side(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks df for broadcast if its counted rows are within the limit, else leaves it to a shuffle join."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def text_of(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 4; rows with 2 are held out from learning."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
