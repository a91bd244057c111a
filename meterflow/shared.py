"""Tables in the folder that the driver and all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession, name: str = "table") -> str:
    """A new path in the shared folder; a session whose tasks run in the driver's own process may do without the setting."""
    where = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set(_KEY, where)
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
    """``df`` as a Parquet table, read back: it is computed once, and a lost executor costs only the tasks it held.

    With ``path`` it takes the place of what is there."""
    mode, path = ("errorifexists", shared_folder(df.sparkSession, name)) if path is None else ("overwrite", path)
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
