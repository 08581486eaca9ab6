"""Tables that are kept by deltas: rows belong to an owner (a file, a document) and are looked up by a key.

A delta appends the rows of new owners, laid out by buckets of the key, and a mark for each owner whose rows went. A row
counts if no later mark names its owner. A lookup reads the buckets of its keys only; compacting writes what counts as one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .snapshots import Append, Replace, View

#: Marks, or keys of a lookup, that are broadcast; beyond that they are shuffled.
SMALL = 200_000
#: Keys of a lookup that go to the scan as a filter.
LISTED = 1_000


class Kept:
    """rows: DDL of the rows, with the owner's columns and the key."""

    def __init__(self, name: str, rows: str, owner: tuple[str, ...], key: str, buckets: int = 32):
        self.name, self.owner, self.key, self.buckets = name, owner, key, buckets
        self.rows = f"{rows}, version long, bucket int"
        kinds = dict(c.split() for c in rows.split(", "))
        self.columns, self.gone = list(kinds), f"{name}_gone"
        self.marks = ", ".join(f"{c} {kinds[c]}" for c in owner) + ", version long"

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _laid_out(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", self.key)

    def delta(self, view: View, rows: DataFrame, gone: DataFrame) -> dict[str, Append]:
        """What a commit writes so that gone owners lose their rows, and then rows come."""
        version = F.lit(view.number + 1).cast("long").alias("version")
        new = rows.select(*self.columns, version, self.bucket(F.col(self.key)).alias("bucket"))
        view.read |= {self.name, self.gone}  # versions are in order of commits
        return {self.name: Append(self._laid_out(new), ("bucket",)), self.gone: Append(gone.select(*self.owner).distinct().select(*self.owner, version).coalesce(1))}

    def read(self, view: View, keys: DataFrame | list | None = None) -> DataFrame:
        """The rows that count, of these keys only if keys are given: a list, or the column `key` of a DataFrame."""
        rows = view.load(self.name, self.rows)
        if isinstance(keys, DataFrame):
            keys = keys.select(F.col(keys.columns[0]).alias(self.key)).distinct()
            some = [r[0] for r in keys.limit(LISTED + 1).collect()]
            if len(some) <= LISTED:
                keys = some
            else:
                rows = rows.join(keys, self.key, "left_semi")
        if isinstance(keys, list):
            spark = view.store.spark
            own = spark.createDataFrame([(k,) for k in keys if k is not None], f"k {dict(rows.dtypes)[self.key]}").select(self.bucket(F.col("k"))).distinct().collect()
            rows = rows.where(F.col("bucket").isin([r[0] for r in own])).where(F.col(self.key).isin([k for k in keys if k is not None]))
        marks = view.load(self.gone, self.marks)
        if view.tables.get(self.gone):
            last = marks.groupBy(*(F.col(c).alias(f"_{c}") for c in self.owner)).agg(F.max("version").alias("_version"))
            if n := last.limit(SMALL + 1).count():
                on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in self.owner] + [F.col("version") < F.col("_version")]
                cond = on[0]
                for c in on[1:]:
                    cond = cond & c
                rows = rows.join(F.broadcast(last) if n <= SMALL else last, cond, "left_anti")
        return rows.select(self.columns)

    def compact(self, view: View) -> dict[str, Replace]:
        """What a commit writes so that only rows that count are left, in one folder."""
        rows = self.read(view).select(*self.columns, F.lit(view.number + 1).cast("long").alias("version"), self.bucket(F.col(self.key)).alias("bucket"))
        return {self.name: Replace(self._laid_out(rows), ("bucket",)), self.gone: Replace(view.load(self.gone, self.marks).limit(0))}
