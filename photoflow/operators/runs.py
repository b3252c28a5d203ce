"""Model runs: attempts to final responses, document and export status, recorded results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve_attempts(attempts: DataFrame, repair_limit: int = 1, run: str = "run_id") -> DataFrame:
    """One row per run of ``attempts(run, attempt_no, status, error_code, response, transport_error)`` (RUN1-RUN3).

    Of the first ``repair_limit + 1`` attempts: the first valid one, else the last; response data come from the last
    completed one, and a transport error in a repair is the run's error. ``attempts`` is kept where there are several.
    """
    first = Window.partitionBy(run).orderBy("attempt_no")
    df = attempts.withColumn("_n", F.row_number().over(first)).where(f"_n <= {repair_limit + 1}")
    done = F.col("transport_error").isNull()
    valid = F.coalesce(done & (F.col("status") == "valid"), F.lit(False))
    record = F.struct("attempt_no", "status", "error_code", "response", "transport_error")
    g = df.groupBy(run).agg(
        F.min_by(record, F.when(valid, F.col("_n"))).alias("good"), F.max_by(record, F.when(done, F.col("_n"))).alias("completed"), F.max_by(record, "_n").alias("last"),
        F.sort_array(F.collect_list(F.struct("attempt_no", "status", "error_code"))).alias("all"), F.count("*").alias("n_attempts"),
    )
    pick = F.coalesce("good", "completed", "last")
    g = g.withColumn("_p", pick)
    code = F.when(F.col("good").isNotNull(), None).otherwise(F.coalesce("last.transport_error", "_p.error_code"))
    return g.select(
        run, F.col("_p.attempt_no").alias("final_attempt"), F.col("_p.status").alias("status"), F.col("good").isNotNull().alias("json_valid"), F.col("_p.response").alias("response"),
        code.alias("error_code"), "n_attempts", F.when(F.col("n_attempts") > 1, F.col("all")).alias("attempts"),
    )


def document_status(runs: DataFrame, document: str = "document_id", skipped: str | None = None) -> DataFrame:
    """written if a run is valid and without error, else failed; skipped documents stay so (RUN4)."""
    good = F.col("json_valid") & F.col("error_code").isNull()
    skip = F.coalesce(F.bool_or(F.col(skipped)), F.lit(False)) if skipped else F.lit(False)
    return runs.groupBy(document).agg(F.when(skip, "skipped_existing").when(F.coalesce(F.bool_or(good), F.lit(False)), "written").otherwise("failed").alias("status"))


def document_errors(preparation: DataFrame, runs: DataFrame, document: str = "document_id") -> DataFrame:
    """Preparation errors, then the runs' errors, each by ``position`` (RUN5)."""
    both = preparation.select(document, F.lit(0).alias("part"), "position", "error_code").union(runs.select(document, F.lit(1).alias("part"), "position", "error_code"))
    both = both.where("error_code is not null")
    return both.groupBy(document).agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "position", "error_code"))), lambda e: e["error_code"]).alias("errors"))


def prep_status(mode: str, isolation_error: Column, render_error: Column) -> Column:
    """Of the pipeline before the model: a subject-only run fails with its isolation (RUN6)."""
    bad = render_error.isNotNull() | (isolation_error.isNotNull() if mode == "subject" else F.lit(False))
    return F.when(bad, "failed").otherwise("written")


def export_status(outputs: DataFrame, source: str = "relative_path") -> DataFrame:
    """``outputs(source, output, action, error_code)`` to failed, partial, skipped or exported (RUN7)."""
    there = F.col("output").isNotNull() & F.col("error_code").isNull()
    g = outputs.groupBy(source).agg(F.count_if(there).alias("n_outputs"), F.count_if(F.col("error_code").isNotNull()).alias("n_errors"), F.count_if(there & (F.col("action") == "skip_existing")).alias("n_skipped"))
    status = F.when(F.col("n_outputs") == 0, "failed").when(F.col("n_errors") > 0, "partial").when(F.col("n_skipped") == F.col("n_outputs"), "skipped").otherwise("exported")
    return g.withColumn("status", status)


def classify_transport(log: DataFrame, retries: int = 2, request: str = "request_id") -> DataFrame:
    """``log(request, attempt, outcome)``: the outcome after ``retries + 1`` attempts (RUN8).

    ok if one succeeded, else E_MODEL_TIMEOUT or E_MODEL_RUNTIME_UNREACHABLE by the last attempt's error.
    """
    df = log.where(f"attempt <= {retries}")
    g = df.groupBy(request).agg(F.bool_or(F.col("outcome") == "ok").alias("ok"), F.max_by("outcome", "attempt").alias("last"), F.count("*").alias("n_attempts"))
    return g.select(request, "n_attempts", F.when(F.col("ok"), None).when(F.col("last") == "timeout", "E_MODEL_TIMEOUT").otherwise("E_MODEL_RUNTIME_UNREACHABLE").alias("error_code"))


def duration_ms(start: Column, end: Column) -> Column:
    """Rounded to milliseconds, never negative (RUN9)."""
    return F.greatest(F.lit(0), F.round((F.unix_micros(end) - F.unix_micros(start)) / 1000.0)).cast("long")


def lookup_recorded(inputs: DataFrame, recorded: DataFrame) -> DataFrame:
    """``inputs(input_id, role, sha)`` with ``response``: recorded for role and sha, else the role's first, else an error (PLN7).

    ``recorded(position, role, sha, response)``; of several the least position counts.
    """
    exact = recorded.groupBy("role", "sha").agg(F.min_by("response", "position").alias("exact"))
    by_role = recorded.groupBy("role").agg(F.min_by("response", "position").alias("fallback"))
    df = inputs.join(exact, ["role", "sha"], "left").join(F.broadcast(by_role), "role", "left")  # a row per role
    return df.select("input_id", "role", "sha", F.coalesce("exact", "fallback").alias("response"), F.when(F.coalesce("exact", "fallback").isNull(), "E_MODEL_NO_RECORDED_RESULT").alias("error_code"))
