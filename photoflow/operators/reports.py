"""Summaries of batches, exports and benchmark documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photoflow.sources.shared import written

STATUSES = ["written", "skipped_existing", "dry_run", "failed"]
EXPORT_STATUSES = ["exported", "skipped", "partial", "failed"]


def batch_counts(images: DataFrame, progress: DataFrame, interrupted: DataFrame | None = None, batch: str = "batch_id") -> DataFrame:
    """Per batch: images of the scan, a count per status, and whether it was interrupted (AGG1). ``interrupted(batch)`` lists such batches."""
    n = images.groupBy(batch).agg(F.count("*").alias("total_images"))
    out = n.join(progress.groupBy(batch).agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES]), batch, "full")
    stopped = interrupted.select(batch).distinct().withColumn("interrupted", F.lit(True)) if interrupted is not None else None
    out = out.join(stopped, batch, "left") if stopped is not None else out.withColumn("interrupted", F.lit(False))
    zero = F.lit(0).cast("long")
    return out.select(batch, *[F.coalesce(c, zero).alias(c) for c in ("total_images", *STATUSES)], F.coalesce("interrupted", F.lit(False)).alias("interrupted"))


def batch_errors(progress: DataFrame, interrupted: DataFrame | None = None, batch: str = "batch_id") -> DataFrame:
    """A row per error of a batch: ``batch, position, code, last``; an interrupted batch has E_INTERRUPTED behind all others (AGG1)."""
    own = progress.where("error_code is not null").select(batch, F.col("position").cast("long").alias("position"), F.col("error_code").alias("code"), F.lit(0).alias("last"))
    if interrupted is None:
        return own
    return own.union(interrupted.select(batch).distinct().select(batch, F.lit(None).cast("long"), F.lit("E_INTERRUPTED"), F.lit(1)))


def batch_summary(images: DataFrame, progress: DataFrame, interrupted: DataFrame | None = None, batch: str = "batch_id") -> DataFrame:
    """:func:`batch_counts` with a batch's error codes in one array (AGG1), for batches that are small; others are documents in parts.

    ``images`` and ``progress(batch, position, status, error_code)``; ``interrupted(batch)`` lists interrupted batches.
    """
    errors = batch_errors(progress, interrupted, batch)
    codes = errors.groupBy(batch).agg(F.transform(F.sort_array(F.collect_list(F.struct("last", "position", "code"))), lambda e: e["code"]).alias("errors"))
    out = batch_counts(images, progress, interrupted, batch).drop("interrupted").join(codes, batch, "left")
    return out.withColumn("errors", F.coalesce("errors", F.array().cast("array<string>")))


def export_summary(records: DataFrame, run: str = "run_id") -> DataFrame:
    return records.groupBy(run).agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in EXPORT_STATUSES])  # AGG2


def upper_median(c: Column) -> Column:
    """The element at half the count of the sorted values; of an even count the upper middle one; null of none (AGG5).

    As an aggregate, which keeps each distinct value of a group in one buffer: for groups that are known to be small. For
    others there is :func:`upper_medians`.
    """
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c if isinstance(c, str) else c._jc.toString()} DESC)")


#: Bits of a value that a pass settles; a group has 2**BITS counts at most.
BITS = 16
#: Groups whose state is broadcast at most.
BROADCAST_GROUPS = 100_000


def upper_medians(df: DataFrame, by: list[str], values: dict[str, str], bits: int = BITS) -> DataFrame:
    """``by`` and, for each ``name: column`` of ``values``, the group's upper median of an integer column (AGG5), by radix selection.

    All groups and columns go together. Their values' leading bits are counted (before the shuffle too), a running sum over
    a group's counts says where its median lies, and the next pass looks at the values that begin so; bits that all values
    of a group share take no pass. No task holds more than ``2**bits`` counts of a group, however many values it has. Null
    values don't count; a group without values has nulls. Null group keys are a group.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    own = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], *[F.col(c).cast("long").alias(f"_v{i}") for i, c in enumerate(values.values())])
    each = own.select(*keys, F.posexplode(F.array(*[f"_v{i}" for i in range(len(values))])).alias("_c", "_v"))
    # the order of longs is that of these bits, read without a sign
    each = each.where("_v is not null").select(*keys, "_c", F.col("_v").bitwiseXOR(F.lit(-(2**63))).alias("_b"))
    g = [*keys, "_c"]
    ends = written(each.groupBy(*g).agg(F.min(F.col("_b").bitwiseXOR(F.lit(-(2**63)))).alias("lo"), F.max(F.col("_b").bitwiseXOR(F.lit(-(2**63)))).alias("hi"), F.count("*").alias("n")), "medians")
    top = ends.agg(F.count("*").alias("groups"), F.max(F.length(F.bin(F.col("lo").bitwiseXOR(F.col("hi"))))).alias("bits")).first()
    few, at = top["groups"] <= BROADCAST_GROUPS, 64 if top["groups"] == 0 else int(top["bits"])
    state = ends.select(*g, F.when(F.lit(at < 64), F.expr(f"shiftrightunsigned(lo ^ {-(2**63)}L, {at % 64})")).otherwise(F.lit(0).cast("long")).alias("head"), F.expr("n div 2").alias("rank"))
    while at and top["groups"]:
        low = max(0, at - bits)
        now = state.select(*[F.col(c).alias(f"s{c}") for c in g], "head", "rank")
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"s{c}")) for c in g])
        begins = F.expr(f"shiftrightunsigned(_b, {at})" if at < 64 else "0L") == F.col("head")
        counts = each.join(F.broadcast(now) if few else now, same & begins).groupBy(*g, "head", "rank", F.expr(f"shiftrightunsigned(_b, {low}) & {2 ** (at - low) - 1}L").alias("digit")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*g).orderBy("digit"))
        found = counts.withColumn("upto", upto).where("rank < upto and rank >= upto - n")
        state = written(found.select(*g, F.expr(f"shiftleft(head, {at - low}) | digit" if at < 64 else "digit").alias("head"), F.expr("rank - (upto - n)").alias("rank")), "medians")
        at = low
    median = F.col("head").bitwiseXOR(F.lit(-(2**63)))
    out = state.groupBy(*keys).agg(*[F.max(F.when(F.col("_c") == i, median)).alias(name) for i, name in enumerate(values)])
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"g{k}")) for k in keys])
    return own.select(*[F.col(k).alias(f"g{k}") for k in keys]).distinct().join(out, same, "left").select(*[F.col(f"g{k}").alias(c) for c, k in zip(by, keys, strict=True)], *values)


def bench_metrics(documents: DataFrame, runs: DataFrame, bench: str = "bench_id") -> DataFrame:
    """Per benchmark run, from ``documents(bench, doc_id, n_errors, pipeline_ms)`` and ``runs(bench, json_valid, n_attempts, load_ns, duration_ms)`` (AGG3, AGG5, AGG6).

    Both are read in each pass of the medians, so they are worked out once, as tables.
    """
    documents = written(documents.select(bench, "n_errors", "pipeline_ms"), "documents")
    runs = written(runs.select(bench, "json_valid", "n_attempts", "load_ns", "duration_ms"), "runs")
    d = documents.groupBy(bench).agg(F.count("*").alias("documents"), F.count_if(F.col("n_errors") > 0).alias("failed_documents"))
    r = runs.groupBy(bench).agg(
        F.count("*").alias("runs"), F.count_if("json_valid").alias("valid_runs"), F.sum(F.greatest(F.coalesce("n_attempts", F.lit(0)) - 1, F.lit(0))).alias("repair_attempts"),
        F.sum(F.coalesce("load_ns", F.lit(0))).alias("load_ns"),
    )
    none = F.lit(None).cast("long")
    both = documents.select(bench, F.col("pipeline_ms").cast("long").alias("p"), none.alias("r")).union(runs.select(bench, none, F.col("duration_ms").cast("long")))
    medians = upper_medians(both, [bench], {"median_pipeline_ms": "p", "median_run_ms": "r"})
    return d.join(r, bench, "full").join(medians, bench).select(bench, "documents", "failed_documents", "median_pipeline_ms", "runs", "valid_runs", "repair_attempts", "load_ns", "median_run_ms")


def error_code_counts(document_errors: DataFrame, attempt_errors: DataFrame, run_errors: DataFrame, bench: str = "bench_id") -> DataFrame:
    """Each error code at each of the three levels, counted together (AGG4)."""
    own = [x.select(bench, "error_code") for x in (document_errors, attempt_errors, run_errors)]
    return own[0].union(own[1]).union(own[2]).where("error_code is not null").groupBy(bench, "error_code").agg(F.count("*").alias("n"))


def batch_success(batches: DataFrame, progress: DataFrame, interrupted: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Not interrupted, and nothing failed; an empty batch succeeds (AGG7)."""
    ok = progress.groupBy(batch).agg(F.bool_and(F.coalesce(F.col("status") != "failed", F.lit(True))).alias("_ok"))
    out = batches.select(batch).distinct().join(ok, batch, "left").join(interrupted.select(batch).distinct().withColumn("_i", F.lit(True)), batch, "left")
    return out.select(batch, (F.coalesce("_ok", F.lit(True)) & F.col("_i").isNull()).alias("success"))


def calibrate_concurrency(runs: DataFrame, within: float = 0.05) -> DataFrame:
    """The lowest ``stage_concurrency`` without errors whose median is within 5 % of the fastest (AGG8)."""
    medians = upper_medians(runs, ["stage_concurrency"], {"median_ms": "pipeline_ms"}).withColumn("median_ms", F.col("median_ms").cast("double"))
    ok = medians.join(runs.groupBy("stage_concurrency").agg(F.sum("error_count").alias("errors")).where("errors = 0"), "stage_concurrency")
    best = ok.agg(F.min("median_ms").alias("best"))  # a row per setting, and one
    return ok.join(F.broadcast(best), F.col("median_ms") <= F.col("best") * (1 + within)).agg(F.min("stage_concurrency").alias("stage_concurrency"))


def calibrate_keep_alive(runs: DataFrame, order: tuple[str, ...] = ("0", "5m", "30m")) -> DataFrame:
    """The smallest ``model_keep_alive`` without a reload, else the last of ``order`` (AGG9)."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("model_keep_alive"))
    g = runs.groupBy("model_keep_alive").agg(F.sum(F.coalesce("load_duration_ns", F.lit(0))).alias("loads"))
    return g.where("loads = 0").agg(F.coalesce(F.min_by("model_keep_alive", rank), F.lit(order[-1])).alias("model_keep_alive"))
