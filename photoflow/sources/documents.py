"""Provenance documents, progress logs and manifests: reading, writing, merging, exploding."""

from __future__ import annotations

import os
import shutil
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photoflow.functions import json_schema as J
from photoflow.operators.reports import EXPORT_STATUSES, batch_counts, batch_errors
from photoflow.sources.inventory import walked
from photoflow.sources.merge import merge_documents  # noqa: F401
from photoflow.sources.parts import write_parts
from photoflow.sources.shared import drop, written
from photoflow.sources.tree_sink import write_documents  # noqa: F401

PROGRESS = "timestamp timestamp, source_path string, relative_path string, sidecar_path string, status string, errors array<struct<code:string,stage:string,message:string,recoverable:boolean>>, duration_ms bigint"


def read_documents(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """One JSON object per file to ``path, doc`` (VARIANT), and what isn't an object with its ``error_code`` (SRC5)."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("doc"))
    return split_documents(raw)


#: Files that a task of :func:`read_tree` reads, and characters that it hands on together, give or take.
TASK_FILES, SOME_CHARS = 20_000, 8_000_000


def read_texts(files: DataFrame) -> DataFrame:
    """The text of each file of ``files(path)``: ``path, value``, and ``problem`` where it can't be read; null where it isn't UTF-8."""

    def run(batches):
        for pdf in batches:
            rows, size = [], 0
            for path in pdf["path"]:
                value = problem = None
                try:
                    with open(path, "rb") as f:
                        value = f.read().decode("utf-8")
                except OSError as e:
                    problem = str(e)
                except UnicodeDecodeError:
                    pass
                rows.append((path, value, problem))
                size += len(value or "")
                if size > SOME_CHARS:
                    yield pd.DataFrame(rows, columns=["path", "value", "problem"])
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=["path", "value", "problem"])

    return files.select("path").mapInPandas(run, "path string, value string, problem string")


def read_tree(spark: SparkSession, root: str, suffix: str = ".ai.json") -> DataFrame:
    """:func:`read_texts` of the files below a mounted folder whose names end so, however many: the driver lists none of them.

    Spark's own reader lists all files on the driver and reads some 30 of them a task.
    """
    found = walked(spark, root, True)[0].where("failure is null").where(F.endswith("path", F.lit(suffix))).select("path")
    return read_texts(found.repartition(max(1, spark.sparkContext.defaultParallelism, -(-found.count() // TASK_FILES)), "path"))


def read_document_tree(spark: SparkSession, root: str, suffix: str = ".ai.json") -> tuple[DataFrame, DataFrame]:
    """:func:`read_documents` of the files of :func:`read_tree`; those that can't be read are E_FILE_READ."""
    raw = read_tree(spark, root, suffix)
    raw = raw.select("path", F.try_parse_json("value").alias("doc"), "problem")
    good, bad = split_documents(raw, F.when(F.col("problem").isNotNull(), "E_FILE_READ").otherwise("E_SIDECAR_INVALID"))
    return good.drop("problem"), bad


def split_documents(raw: DataFrame, code: Column | None = None) -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce(J.kind(F.col("doc")) == "object", F.lit(False))
    return raw.where(ok), raw.where(~ok).select("path", (F.lit("E_SIDECAR_INVALID") if code is None else code).alias("error_code"))


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """A JSONL log; lines that aren't JSON are in ``_corrupt_record`` (SRC6)."""
    return spark.read.schema(PROGRESS + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def append_progress(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)  # SNK3


def canonical_json(doc: Column) -> Column:
    """JSON text with sorted keys (SNK2): a VARIANT's are, a struct's aren't."""
    return F.to_json(doc)


def copy_files(plan: DataFrame, source: str = "cache_path", target: str = "target_path") -> DataFrame:
    """Copy the bytes of rows whose ``action`` is copy, by a temporary file and a rename (SNK5); ``action`` becomes copied or failed.

    Folders are below one that executors share. Rows of other actions stay as they are. A task that runs again copies the same.
    """

    def run(batches):
        for pdf in batches:
            done = []
            for act, a, b in zip(pdf["action"], pdf[source], pdf[target], strict=True):
                if act == "copy":
                    tmp = f"{b}.{uuid.uuid4().hex}.tmp"
                    try:
                        os.makedirs(os.path.dirname(b), exist_ok=True)
                        shutil.copyfile(a, tmp)
                        os.replace(tmp, b)
                        act = "copied"
                    except OSError:
                        act = "failed"
                done.append(act)
            yield pdf.assign(action=done)

    return plan.mapInPandas(run, plan.schema)


def get(doc: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(doc, path, kind)


def explode_runs(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """A row per model run: ``position, run`` and its usual fields (JSN8)."""
    df = docs.select("*", F.posexplode(get(F.col(doc), "$.model_runs", "array<variant>")).alias("position", "run"))
    return df.withColumns({"json_valid": get(F.col("run"), "$.json_valid", "boolean"), "duration_ms": J.lenient_long(get(F.col("run"), "$.duration_ms")), "load_ns": J.lenient_long(get(F.col("run"), "$.metrics.load_duration_ns")), "n_attempts": F.coalesce(F.size(get(F.col("run"), "$.attempts", "array<variant>")), F.lit(0))})


def explode_errors(docs: DataFrame, doc: str = "doc") -> DataFrame:
    df = docs.select("*", F.posexplode(get(F.col(doc), "$.errors", "array<variant>")).alias("position", "e"))
    return df.withColumns({"error_code": get(F.col("e"), "$.code", "string"), "stage": get(F.col("e"), "$.stage", "string")}).drop("e")


def fill_defaults(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Additive defaults of older documents (FLT14): one repair attempt, no timing, and an empty isolation is none."""
    d = F.col(doc)
    iso = get(d, "$.subject_isolation")
    return docs.withColumns({
        "repair_attempts": F.coalesce(J.lenient_long(get(d, "$.run_configuration.response_repair_attempts")), F.lit(1)),
        "pipeline_ms": J.lenient_long(get(d, "$.timing.pipeline_ms")),
        "isolation_status": F.when(J.kind(iso) == "object", get(iso, "$.status", "string")),
    })


def export_records(outputs: DataFrame, run: str = "run_id") -> DataFrame:
    """A row per record of a run: its path, status and outputs, nested; a record has an output for each role."""
    return outputs.groupBy(run, "relative_path", "status").agg(F.sort_array(F.collect_list(F.struct("role", "output", "action"))).alias("outputs"))


def write_export_manifests(outputs: DataFrame, path: str, run: str = "run_id") -> None:
    """A manifest per run: totals, and its records by path with their outputs nested (SNK4), each a document in parts.

    ``outputs(run, relative_path, status, role, output, action)``. A record is as small as its roles; a run may have any
    number of them.
    """
    records = written(export_records(outputs, run), "records")
    totals = records.groupBy(run).agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in EXPORT_STATUSES])
    write_parts(totals, records, path, run, ["relative_path", "status"], "records", F.struct("relative_path", "status", "outputs"))
    drop(records)


def write_batch_summaries(images: DataFrame, progress: DataFrame, interrupted: DataFrame | None, path: str, batch: str = "batch_id") -> None:
    """A summary per batch (AGG1) as a document in parts: the counts, and its errors in the order of the log, E_INTERRUPTED last."""
    counts, errors = batch_counts(images, progress, interrupted, batch), batch_errors(progress, interrupted, batch)
    write_parts(counts, errors, path, batch, ["last", "position"], "errors", F.struct("code", "position"))
