"""Output planning: supported files, collisions, existing outputs, resume, and the union of outcomes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photoflow.functions import paths as P
from photoflow.sources.shared import shared_dir

ROLES = ["whole_image", "subject_isolated"]
MODES = {"whole": ROLES[:1], "subject": ROLES[1:], "both": ROLES}
POLICIES = ("skip", "overwrite", "fail")


def visible(inventory: DataFrame, path: str = "relative_path") -> DataFrame:
    """Without what is ignored; a hidden folder hides its subtree (FLT1, FLT2)."""
    return inventory.where(~P.is_ignored(F.col(path)))


def split_supported(inventory: DataFrame, path: str = "relative_path") -> tuple[DataFrame, DataFrame]:
    """Supported images with ``detected_type``, and the visible rest as rows with a recoverable ``error`` (FLT4)."""
    df = visible(inventory, path).withColumn("detected_type", P.detected_type(P.extension(F.col(path))))
    bad = df.where("detected_type is null").select(path, P.error("E_UNSUPPORTED_FORMAT", "scan", F.concat(F.lit("Unsupported file type: "), P.file_name(F.col(path)))).alias("error"))
    return df.where("detected_type is not null"), bad


def explode_roles(images: DataFrame, mode: str) -> DataFrame:
    """A row for each model input role of ``mode`` (FLT10)."""
    return images.withColumn("role", F.explode(F.array(*map(F.lit, MODES[mode]))))


def model_inputs(derivatives: DataFrame, mode: str, image: str = "image_id", position: str = "position") -> DataFrame:
    """The first derivative of each wanted role, whole image before subject (FLT11)."""
    rank = P.rank_of(F.col("role"), MODES[mode])
    w = Window.partitionBy(image, "role").orderBy(position)
    return derivatives.where(rank.isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").withColumn("input_order", rank)


def plan_outputs(images: DataFrame, source: str = "relative_path", output: str = "sidecar_path") -> tuple[DataFrame, DataFrame]:
    """Entries whose output path is theirs alone in any case, and a row per source of each colliding group (PLN1).

    A collision's rows have its folded path, the least path, how many sources it has, and the source: any number of files
    may have one output, and none of it is gathered. :func:`collision_groups` puts a group in one row.
    """
    folded = images.withColumn("_key", F.lower(output))
    many = folded.groupBy("_key").agg(F.count("*").alias("n_sources"), F.min(output).alias("path")).where("n_sources > 1")
    entries = folded.join(many.select("_key"), "_key", "left_anti").drop("_key")
    return entries, folded.select("_key", F.col(source).alias("source")).join(many, "_key").select(F.col("_key").alias("collision_key"), "path", "n_sources", "source")


def collision_groups(collisions: DataFrame) -> DataFrame:
    """A row per colliding group with its sorted sources and a message, to be shown: as large as the group is."""
    group = collisions.groupBy("collision_key", "path").agg(F.sort_array(F.collect_list("source")).alias("sources"))
    return group.withColumn("message", F.concat(F.lit("Output collision: "), F.array_join("sources", ", ")))


def plan_exports(exports: DataFrame, source: str = "relative_path", output: str = "export_path") -> tuple[DataFrame, DataFrame]:
    """``(source, role, output)`` rows to entries of sources none of whose outputs collide, and a failure per source and group (PLN2)."""
    key = exports.withColumn("_key", F.lower(output))
    many = key.groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").select("_key")
    hit = key.join(many, "_key", "left_semi")
    failed = hit.select(source, F.col("_key").alias("collision_key")).distinct()
    return exports.join(hit.select(source).distinct(), source, "left_anti"), failed


def apply_existing(plan: DataFrame, existing: DataFrame, policy: str = "skip", dry_run: bool = False, output: str = "sidecar_path") -> DataFrame:
    """``action`` and ``status`` of each planned output: a dry run comes first, then the policy for outputs that exist (PLN3, PLN4)."""
    df = with_existing(plan, existing, output).withColumn("action", existing_action(policy, dry_run))
    status = F.when(F.col("action") == "dry_run", "dry_run").when(F.col("action") == "skip_existing", "skipped_existing").when(F.col("action") == "fail_existing", "failed").otherwise("planned")
    code = F.when(F.col("action") == "fail_existing", "E_SIDECAR_EXISTS")
    return df.withColumns({"status": status, "error_code": code})


def with_existing(plan: DataFrame, existing: DataFrame, output: str = "sidecar_path") -> DataFrame:
    """``plan`` with whether its output ``exists``: the one join that all policies take."""
    own, there = _co_located(plan, existing, output)
    return own.join(there.withColumn("exists", F.lit(True)), output, "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def existing_action(policy: str = "skip", dry_run: bool = False) -> Column:
    """What is done to an output, by the column ``exists`` (PLN3): a dry run comes first."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    when = {"skip": "skip_existing", "overwrite": "write", "fail": "fail_existing"}[policy]
    return F.lit("dry_run") if dry_run else F.when(F.col("exists"), when).otherwise("write")


def archive_outputs(existing: DataFrame, table: str, buckets: int, output: str = "sidecar_path", location: str | None = None) -> DataFrame:
    """The outputs that exist as a bucketed, sorted table ``table``, each path once: later runs join it where it lies.

    ``location`` is the table's folder, if it isn't to be in the warehouse. A table of this name is replaced.
    """
    writer = existing.select(output).where(F.col(output).isNotNull()).distinct().repartition(buckets, output).write.mode("overwrite").bucketBy(buckets, output).sortBy(output)
    (writer.option("path", location) if location else writer).saveAsTable(table)
    out = existing.sparkSession.table(table)
    out._photoflow_buckets = (buckets, output)
    return out


def _co_located(plan: DataFrame, existing: DataFrame, output: str) -> tuple[DataFrame, DataFrame]:
    """The plan dealt out as an archive's buckets are, so that only the plan is shuffled; other existing outputs as they are, once each."""
    buckets = getattr(existing, "_photoflow_buckets", None)
    if buckets and buckets[1] == output:
        return plan.repartition(buckets[0], output), existing.hint("merge")
    return plan, existing.select(output).distinct()


def pending_work(plan: DataFrame, existing: DataFrame, output: str = "sidecar_path") -> DataFrame:
    """What a resumed batch still has to do: planned, less written (PLN5). Do this before contents are read.

    Where ``existing`` is a table of :func:`archive_outputs`, the archive isn't shuffled.
    """
    own, there = _co_located(plan, existing, output)
    return own.join(there, output, "left_anti")


def union_outcomes(scan_errors: DataFrame, collisions: DataFrame, entries: DataFrame) -> DataFrame:
    """Scan errors, then collisions, then entries: ``stage_rank, path, status, error_code`` (PLN6); order by rank and path."""
    a = scan_errors.select(F.lit(0).alias("stage_rank"), F.col("relative_path").alias("path"), F.lit("failed").alias("status"), F.col("error.code").alias("error_code"))
    b = collisions.select(F.lit(1).alias("stage_rank"), F.col("source").alias("path"), F.lit("failed").alias("status"), F.lit("E_SIDECAR_COLLISION").alias("error_code"))
    c = entries.select(F.lit(2).alias("stage_rank"), F.col("relative_path").alias("path"), "status", "error_code")
    return a.unionByName(b).unionByName(c)


def gate_version(df: DataFrame, version: str = "schema_version", name: str = "image-json", major: int = 1) -> tuple[DataFrame, DataFrame]:
    """Rows of ``name/major.minor`` with this name and major, and the rest with ``E_SCHEMA_UNSUPPORTED`` (FLT13)."""
    v = F.col(version)
    ok = v.rlike(r"^[^/]+/\d+\.\d+$") & (F.split_part(v, F.lit("/"), F.lit(1)) == name) & (F.split_part(F.split_part(v, F.lit("/"), F.lit(2)), F.lit("."), F.lit(1)).try_cast("int") == major)
    ok = F.coalesce(ok, F.lit(False))
    return df.where(ok), df.where(~ok).withColumn("error", P.error("E_SCHEMA_UNSUPPORTED", "sidecar", F.concat(F.lit("Unsupported schema version: "), F.coalesce(v, F.lit("none")))))


LEVELS = ["error", "warn", "info", "debug"]


def level_of_status(status: Column) -> Column:
    return F.when(status == "failed", "error").when(status.isin("skipped_existing", "partial"), "warn").otherwise("info")


def filter_log(log: DataFrame, minimum: str, level: str = "level") -> DataFrame:
    """Records at least as severe as ``minimum``: error < warn < info < debug (FLT12)."""
    return log.where(P.rank_of(F.col(level), LEVELS) <= LEVELS.index(minimum))


def count_extension(inventory: DataFrame, ext: str, path: str = "relative_path") -> DataFrame:
    """How many files of an extension there are, in any case (FLT15)."""
    return inventory.where(F.lower(P.extension(F.col(path))) == ext.lower()).agg(F.count("*").alias("n_files"))


def copy_plan(artifacts: DataFrame, targets: DataFrame, policy: str = "skip") -> DataFrame:
    """``artifacts(artifact_key, cache_path)`` to be copied to ``targets(artifact_key, target_path, exists)`` (SNK5).

    action: missing without an artifact; else copy, or what the policy says of an existing target.
    """
    act = F.when(F.col("cache_path").isNull(), "missing").when(~F.col("exists"), "copy").otherwise({"skip": "skip", "overwrite": "copy", "fail": "fail"}[policy])
    return targets.join(artifacts.select("artifact_key", "cache_path"), "artifact_key", "left").withColumn("action", act)


def places(paths: DataFrame, path: str = "relative_path") -> DataFrame:
    """``paths`` with ``place`` from 1 in case-folded order (FLT7).

    Rows are dealt out by ranges of the whole folded path, so a folder that all share doesn't matter; the ranges are
    written once with their numbers, and each range's places follow those of the ranges before it.
    """
    low, own = P.path_order(F.col(path))
    spark = paths.sparkSession
    to = f"{shared_dir(spark)}/places-{uuid.uuid4().hex}"
    paths.repartitionByRange(low, own).withColumn("_range", F.spark_partition_id()).write.parquet(to)
    dealt = spark.read.schema(paths.withColumn("_range", F.lit(0)).schema).parquet(to)
    n = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = n.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row per range
    within = F.row_number().over(Window.partitionBy("_range").orderBy(low, own))
    return dealt.withColumn("_own", within).join(F.broadcast(before), "_range").withColumn("place", F.col("_own") + F.col("_before")).drop("_own", "_before", "_range")
