"""Shared folder, intermediate tables and connected components for the text operators."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photoflow.sources.shared import shared_dir

WS = r"[\x20\x09-\x0D]+"


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._photoflow_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`materialise` that nothing lazily reads any more."""
    path = getattr(df, "_photoflow_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def sweep(spark) -> None:
    """Have Spark delete the shuffle files of tables that are written and that nothing refers to any more."""
    gc.collect()  # frames in cycles refer to their plans
    for _ in range(2):  # Spark's listeners let go of the last query's plan after the first
        spark._jvm.System.gc()
        time.sleep(0.3)


def used(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """``df``, which reads these tables of :func:`materialise`; :func:`finish` deletes them."""
    df._photoflow_used = tables
    return df


def finish(df: DataFrame) -> None:
    """Delete what ``df`` was read from, when its rows are elsewhere."""
    for table in getattr(df, "_photoflow_used", ()):
        discard(table)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(src, dst)`` (equal integer or string types) to ``(node, component)``, the component's least node.

    Alternating large-star and small-star rounds; each round is joins and ``min`` aggregations, which combine
    before the shuffle, so that a hub is never gathered in one task. Each round's edges are a table in the shared
    folder. Nodes without an edge to another node do not appear. Nulls and self-loops are ignored.
    """
    e = edges.select("src", "dst").where("src <> dst")
    e = e.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e = materialise(e, "cc")
    state = None
    for _ in range(max_rounds):
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state or now["n"] == 0:
            break
        state = now
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour v of u goes to the least of u's neighbourhood
        large = e.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour of u goes to the least of them, and so does u
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        nxt = materialise(small, "cc")
        discard(e)
        e = nxt
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
