"""Artifact cache: probe, upsert, least-recently-used eviction, purge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Names of cached artifacts: a hash, the recipe and the role.
ARTIFACT = r"^[0-9a-f]{64}-.*(whole_image|subject_isolated)\.(jpg|tiff)$"
MANIFEST = "manifest.json"


def cache_probe(requests: DataFrame, entries: DataFrame, files: DataFrame) -> DataFrame:
    """``result`` of each request by (cache_id, file_name): hit, miss without file or entry, corrupt if the hash differs (CCH1)."""
    keys = ["cache_id", "file_name"]
    df = requests.join(entries.select(*keys, F.col("sha256").alias("_want")), keys, "left").join(files.select(*keys, F.col("sha256").alias("_have")), keys, "left")
    result = F.when(F.col("_want").isNull() | F.col("_have").isNull(), "miss").when(F.col("_want") == F.col("_have"), "hit").otherwise("corrupt")
    return df.withColumn("result", result).drop("_want", "_have")


def cache_upsert(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """The latest row of each (cache_id, file_name) by last_accessed_at; a change wins ties (CCH2)."""
    both = entries.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    rest = [c for c in entries.columns if c not in ("cache_id", "file_name")]
    g = both.groupBy("cache_id", "file_name").agg(F.max_by(F.struct(*rest), F.struct("last_accessed_at", "_new")).alias("r"))
    return g.select("cache_id", "file_name", *[F.col(f"r.{c}").alias(c) for c in rest])


def lru_evict(entries: DataFrame, cap: int, protected: DataFrame | None = None) -> DataFrame:
    """``entries`` with ``evict``: oldest first until a cache's total is within ``cap``; protected files stay (CCH3).

    An entry goes if the total less all older candidates is above the cap. Ties in time are broken by name.
    """
    keys = ["cache_id", "file_name"]
    df = entries
    if protected is not None:
        df = df.join(protected.select(*keys).distinct().withColumn("_keep", F.lit(True)), keys, "left")
    else:
        df = df.withColumn("_keep", F.lit(None).cast("boolean"))
    df = df.withColumn("_keep", F.coalesce("_keep", F.lit(False)))
    # a large cache is summed by hours first, so that a task sorts the entries of one hour
    free = F.coalesce(F.when(~F.col("_keep"), F.col("byte_count")), F.lit(0))
    df = df.withColumn("_hour", F.date_trunc("hour", F.col("last_accessed_at").cast("timestamp")))
    hours = df.groupBy("cache_id", "_hour").agg(F.sum(free).alias("_free"), F.sum("byte_count").alias("_all"))
    older = Window.partitionBy("cache_id").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("cache_id", "_hour", F.coalesce(F.sum("_free").over(older), F.lit(0)).alias("_before"), F.sum("_all").over(Window.partitionBy("cache_id")).alias("_total"))
    within = Window.partitionBy("cache_id", "_hour").orderBy("last_accessed_at", "file_name").rowsBetween(Window.unboundedPreceding, -1)
    df = df.join(hours.withColumnRenamed("cache_id", "_cache").withColumnRenamed("_hour", "_at"), F.col("cache_id").eqNullSafe(F.col("_cache")) & F.col("_hour").eqNullSafe(F.col("_at")))
    gone = F.col("_before") + F.coalesce(F.sum(free).over(within), F.lit(0))
    return df.withColumn("evict", ~F.col("_keep") & (F.col("_total") - gone > cap)).drop("_keep", "_hour", "_cache", "_at", "_before", "_total")


def purge_candidates(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Files of a cache folder that a purge removes: known ones, the manifest, and names of the artifact pattern (CCH4)."""
    keys = ["cache_id", "file_name"]
    known = files.join(entries.select(*keys).distinct().withColumn("_known", F.lit(True)), keys, "left")
    return known.where(F.col("_known").isNotNull() | (F.col("file_name") == MANIFEST) | F.col("file_name").rlike(ARTIFACT)).drop("_known")


def purge_summary(removed: DataFrame) -> DataFrame:
    return removed.groupBy("cache_id").agg(F.count("*").alias("removed"))  # CCH5
