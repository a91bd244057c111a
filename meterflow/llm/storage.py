"""Written intermediates in the folder that all executors share.

Lineage is cut by Parquet tables under ``spark.checkpoint.dir``; a lost executor then costs only the tasks it
held.  Where a local session has no such setting (tests), a temporary folder is made and set; a cluster must name one.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or one of our own where the session names none."""
    where = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set(_KEY, where)
    return where.rstrip("/")


_open: list[list[str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def result(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` gives as a written table; the tables that were written on the way are deleted."""
    _open.append([])
    try:
        out = written(make(), name)
    finally:
        made = _open.pop()
    for path in made:
        if path != out._shared_path:
            _delete(spark, path)
    return out


def text_bytes(df: DataFrame, text: str) -> int:
    """UTF-8 bytes of a text column."""
    return df.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, last: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back with its schema; with ``last`` nothing else reads its shuffles,
    whose files go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    if last:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if last:
            spark.conf.set(_CLEANUP, before) if before else spark.conf.unset(_CLEANUP)
    for own in _open:
        own.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``written`` made, once nothing reads it any more."""
    path = getattr(df, "_shared_path", None)
    if path:
        _delete(df.sparkSession, path)


def freed(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of queries that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


_BITS = 27


def map_bits(values: int) -> int:
    """Bits of a map of some values: 64 to 128 for each, so that at most one value in 64 that is not wanted passes, up to 2^27."""
    return min(_BITS, max(15, (64 * values - 1).bit_length()))


def bit_map(df: DataFrame, column: str, bits: int = _BITS) -> bytes:
    """A bit for each value of a long column, of 2^``bits`` (at most 2^27, 16 MB): at most 4,096 rows of 4 KB reach the driver, whatever the table's size."""
    place = F.pmod(F.col(column), F.lit(1 << bits)) + 1
    rows = df.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = bytearray((1 << bits) // 8)
    for r in rows.collect():
        out[(r["bucket"] - 1) << 12 : r["bucket"] << 12] = r["bits"]
    return bytes(out)


def in_bit_map(bits: bytes, values: np.ndarray) -> np.ndarray:
    """Which longs have their bit set: all that the map was made of, and a share of others that grows with it."""
    place = values & (8 * len(bits) - 1)
    return (np.frombuffer(bits, np.uint8)[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with other names for its columns that clash with an operator's own ``names``, and what to rename back (new to old)."""
    taken = {c.lower() for c in df.columns} | {n.lower() for n in names}
    back = {}
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            new = c
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
            back[new] = c
    return df.withColumnsRenamed({c: new for new, c in back.items()}), back


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Whole texts go to Python in Arrow batches of about ``size`` bytes, where the session has Spark's own default (64 MB)."""
    if spark.conf.get(_BATCH, None) == f"{64 << 20}b":
        spark.conf.set(_BATCH, f"{size}b")


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
