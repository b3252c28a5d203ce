"""The folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a temporary folder, once a session, and only on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("photoflow.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="photoflow-")
        spark.conf.set("photoflow.dir", found)
    return found.rstrip("/")


def mounted_dir(spark: SparkSession) -> str:
    """:func:`shared_dir` as a path of the file system, for what reads and writes plain files on it."""
    found = shared_dir(spark)
    if not re.match(r"(file:)?/", found):
        raise ValueError(f"plain files need a folder that is mounted everywhere, not {found}")
    return re.sub(r"^file:/*", "/", found)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: what ran once is read, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._photoflow_path = path
    return out


#: Rows that a task of :func:`dealt` takes, give or take.
TASK_ROWS = 400_000


def dealt(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """:func:`written`, with its rows dealt by ``keys`` to tasks of some TASK_ROWS rows each, however many there are.

    What is then grouped by ``keys`` and more stays in these tasks. Without it, Spark joins shuffled partitions up to a size
    in compressed bytes, which may be millions of short rows, and each step of the task keeps its groups of them in memory.
    """
    table = written(df, name)
    return table.repartition(max(1, -(-table.count() // TASK_ROWS)), *keys)


def drop(df: DataFrame) -> None:
    """Delete a table of :func:`written` that nothing lazily reads any more."""
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._photoflow_path)
    p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
