"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, the folder that driver and executors share.

    Where that setting is absent, a local master takes a temporary folder; any other refuses, as its executors share none.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_graphlens_dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="graphlens-")
        spark._graphlens_dir = base
    _made.append(f"{base.rstrip('/')}/graphlens-{uuid.uuid4().hex}")
    return _made[-1]


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what was written to the shared folder inside; results have to be stored or collected by then."""
    start = len(_made)
    try:
        yield
    finally:
        for path in _made[start:]:
            remove(spark, path)
        del _made[start:]


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order, name: str = "n") -> DataFrame:
    """df with each row's number from 0 in the whole order: its place in its range partition plus the rows of those before."""
    place = f"_{name}"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumn(place, F.monotonically_increasing_id()))  # partition << 33 | place
    part = F.shiftright(place, 33)
    total, offsets = 0, []
    for p, n in sorted(tuple(r) for r in ranged.groupBy(part).count().collect()):
        offsets.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(offsets, "_p long, _offset long")
    out = ranged.withColumn("_p", part).join(F.broadcast(offsets), "_p")
    return out.withColumn(name, F.col("_offset") + F.col(place).bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_offset", place)
