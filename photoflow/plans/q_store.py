"""Queries that write the views' rows as files, logs and documents and read them back (SRC, SNK, VOC1)."""

import uuid

from pyspark.sql import functions as F

from photoflow.functions import identity as I
from photoflow.operators import planning as L
from photoflow.operators import vocabulary as V
from photoflow.plans.fixtures import ctes, view
from photoflow.plans.q_files import _EXT, _IGNORED, _NAME
from photoflow.plans.registry import query
from photoflow.sources import documents as D
from photoflow.sources import tree_sink as W
from photoflow.sources.inventory import scan_inventory
from photoflow.sources.shared import mounted_dir

_FILES = f"""{ctes("v_inventory")},
f AS (SELECT relative_path, arg_min(coalesce(content, ''), doc_id) AS content, min(doc_id) AS doc_id FROM v_inventory GROUP BY 1)"""


def _folder(spark) -> str:
    return f"{mounted_dir(spark)}/files-{uuid.uuid4().hex}"


def _contents(spark, sf):
    body = F.coalesce("content", F.lit(""))
    return view(spark, sf, "v_inventory").groupBy("relative_path").agg(F.min_by(body, "doc_id").alias("content"), F.min("doc_id").alias("doc_id"))


def _tree(spark, sf) -> str:
    """The inventory's files, written."""
    root = _folder(spark)
    D.write_documents(_contents(spark, sf), root, "overwrite", "relative_path", "content")
    return root


@query(f"""{_FILES} SELECT relative_path, {_NAME} AS file_name, {_EXT} AS file_extension, strlen(content) AS file_size, sha256(content) AS sha256
FROM f WHERE NOT {_IGNORED}""")
def src_scan(spark, sf):
    """SRC1, SNK1: a tree is written and scanned, with sizes and content hashes."""
    files, _errors = scan_inventory(spark, _tree(spark, sf), recursive=True)
    return I.file_identity(files).select("relative_path", "file_name", "file_extension", "file_size", F.col("identity.sha256").alias("sha256"))


@query(f"""{_FILES}, k AS (SELECT * FROM f WHERE NOT {_IGNORED})
SELECT 'file' AS what, {_NAME} AS relative_path, strlen(content) AS file_size FROM k WHERE relative_path = (SELECT min(relative_path) FROM k)
UNION ALL SELECT 'folder', {_NAME}, strlen(content) FROM k WHERE starts_with(relative_path, 'roll03/')
UNION ALL SELECT 'missing', 'FileNotFoundError', NULL""")
def src_roots(spark, sf):
    """SRC2, SRC3: one file, one folder's own level, and a root that isn't there."""
    root = _tree(spark, sf)
    files, _errors = scan_inventory(spark, root, recursive=True)
    one = files.agg(F.min("path")).first()[0]
    rows = [scan_inventory(spark, path)[0].select(F.lit(what).alias("what"), "relative_path", "file_size") for what, path in (("file", one), ("folder", f"{root}/roll03"))]
    try:
        scan_inventory(spark, f"{root}/none")
        said = ""
    except FileNotFoundError as e:
        said = type(e).__name__
    return rows[0].union(rows[1]).union(spark.range(1).select(F.lit("missing"), F.lit(said), F.lit(None).cast("long")))


@query(f"""{_FILES} SELECT relative_path, CASE WHEN doc_id % 5 = 0 THEN 'E_FILE_READ' END AS error_code, CASE WHEN doc_id % 5 <> 0 THEN sha256(content) END AS sha256
FROM f WHERE NOT {_IGNORED}""")
def src_unreadable(spark, sf):
    """SRC4: files that are gone when they are read become error rows, and the others are read."""
    files, _errors = scan_inventory(spark, _tree(spark, sf), recursive=True)
    files = files.join(_contents(spark, sf).select("relative_path", "doc_id"), "relative_path")
    files = files.withColumn("path", F.when(F.col("doc_id") % 5 == 0, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")))
    return I.file_identity(files).select("relative_path", F.col("error.code").alias("error_code"), F.col("identity.sha256").alias("sha256"))


_DOC = "CASE doc_id % 7 WHEN 0 THEN '- term: ' || CAST(doc_id AS STRING) WHEN 1 THEN '[1,2]' ELSE '{\"n_chars\":' || CAST(n_chars AS STRING) || ',\"doc_id\":' || CAST(doc_id AS STRING) || '}' END"
_PATH = "'d' || CAST(doc_id % 20 AS STRING) || '/' || CAST(doc_id AS STRING) || '.ai.json'"


@query("""SELECT doc_id, CASE WHEN doc_id % 7 > 1 THEN n_chars END AS n_chars, CASE WHEN doc_id % 7 < 2 THEN 'E_SIDECAR_INVALID' END AS error_code FROM documents""")
def src_documents(spark, sf):
    """SRC5, SNK1: documents are written one to a file and read back; what isn't a JSON object is an error row."""
    root = _folder(spark)
    docs = view(spark, sf, "documents").selectExpr(f"{_PATH} AS path", f"{_DOC} AS json")
    D.write_documents(docs, root, "overwrite", "path", "json")
    good, bad = D.read_document_tree(spark, root)
    number = F.regexp_extract("path", r"([0-9]+)\.ai\.json$", 1).cast("long").alias("doc_id")
    good = good.select(number, D.get(F.col("doc"), "$.n_chars", "bigint").alias("n_chars"), F.lit(None).cast("string").alias("error_code"))
    return good.union(bad.select(number, F.lit(None).cast("long"), "error_code"))


@query(f"""{ctes("v_progress")} SELECT source_path, status, count(*) AS n, sum(duration_ms)::BIGINT AS duration_ms, min(error_code) AS error_code, 0::BIGINT AS n_broken FROM v_progress GROUP BY 1, 2
UNION ALL SELECT NULL, NULL, count(*), NULL, NULL, count(*) FROM v_progress WHERE event_id % 100 = 0""")
def src_progress(spark, sf):
    """SRC6, SNK3: a log that is appended to twice, with lines that aren't JSON between."""
    root = _folder(spark)
    log = view(spark, sf, "v_progress")
    error = F.struct(F.col("error_code").alias("code"), F.lit("model").alias("stage"), F.lit("").alias("message"), F.lit(True).alias("recoverable"))
    rows = log.select(F.col("ts").cast("timestamp").alias("timestamp"), "source_path", F.col("source_path").alias("relative_path"), F.concat("source_path", F.lit(".ai.json")).alias("sidecar_path"), "status", F.when(F.col("error_code").isNotNull(), F.array(error)).otherwise(F.array()).alias("errors"), "duration_ms", (F.col("event_id") % 2).alias("half"))
    for half in (0, 1):
        D.append_progress(rows.where(F.col("half") == half).drop("half"), root)
    log.where("event_id % 100 = 0").select(F.concat(F.lit("{broken "), F.col("event_id").cast("string"))).write.mode("append").text(root)
    read = D.read_progress(spark, root)
    return read.groupBy("source_path", "status").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("duration_ms"), F.min(F.get("errors", F.lit(0))["code"]).alias("error_code"), F.count("_corrupt_record").alias("n_broken"))


_KEPT = "CASE WHEN doc_id % 6 < 3 THEN '{\"new\":' || CAST(doc_id AS STRING) || '}' ELSE " + _DOC + " END"


@query(f"""SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'written' ELSE CASE doc_id % 3 WHEN 0 THEN 'skipped_existing' WHEN 1 THEN 'written' ELSE 'failed' END END AS outcome,
CASE WHEN doc_id % 10 <> 9 AND doc_id % 3 = 2 THEN 'E_SIDECAR_EXISTS' END AS error_code, true AS same_again,
CASE WHEN doc_id % 10 = 9 OR doc_id % 3 = 1 THEN {_KEPT} ELSE {_DOC} END AS json FROM documents""".replace("STRING", "VARCHAR"))
def snk_documents(spark, sf):
    """SNK1: documents that exist are kept, replaced, or fail, by the policy, with equal text too; a second run of the tasks says the same.

    One document of ten isn't there before; the new text of half of them is the old one.
    """
    root = _folder(spark)
    docs = view(spark, sf, "documents").selectExpr("doc_id", f"{_PATH} AS path", f"{_DOC} AS json", f"{_KEPT} AS new")
    W.write_documents(docs.where("doc_id % 10 <> 9"), root, "overwrite", "path", "json")
    number = F.regexp_extract("path", r"([0-9]+)\.ai\.json$", 1).cast("long").alias("doc_id")
    done = None
    for k, policy in enumerate(("skip", "overwrite", "fail")):
        staged = W.stage(docs.where(F.col("doc_id") % 3 == k), root, "path", "new")
        first, again = W.publish(staged, policy), W.publish(staged, policy)  # as if each task had been run twice
        W.clear(staged)
        said = first.join(again.select("path", F.col("outcome").alias("o"), F.col("error_code").alias("e")), "path", "left")
        said = said.select(number, "outcome", "error_code", (F.equal_null("outcome", "o") & F.equal_null("error_code", "e")).alias("same_again"))
        done = said if done is None else done.union(said)
    left = D.read_tree(spark, root).select("path", F.col("value").alias("json"))
    return left.select(number, "json").join(done, "doc_id").select("doc_id", "outcome", "error_code", "same_again", "json")


@query(f"""{_FILES} SELECT relative_path, CASE WHEN doc_id % 5 = 0 THEN 'E_FILE_READ' END AS error_code, CASE WHEN doc_id % 5 <> 0 THEN sha256(content) END AS sha256
FROM f WHERE NOT {_IGNORED}""")
def src_unreadable(spark, sf):
    """SRC4: files that are gone when they are read become error rows, and the others are read."""
    files, _errors = scan_inventory(spark, _tree(spark, sf), recursive=True)
    files = files.join(_contents(spark, sf).select("relative_path", "doc_id"), "relative_path")
    files = files.withColumn("path", F.when(F.col("doc_id") % 5 == 0, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")))
    return I.file_identity(files).select("relative_path", F.col("error.code").alias("error_code"), F.col("identity.sha256").alias("sha256"))


_DOC = "CASE doc_id % 7 WHEN 0 THEN '- term: ' || CAST(doc_id AS STRING) WHEN 1 THEN '[1,2]' ELSE '{\"n_chars\":' || CAST(n_chars AS STRING) || ',\"doc_id\":' || CAST(doc_id AS STRING) || '}' END"
_PATH = "'d' || CAST(doc_id % 20 AS STRING) || '/' || CAST(doc_id AS STRING) || '.ai.json'"


@query("""SELECT doc_id, CASE WHEN doc_id % 7 > 1 THEN n_chars END AS n_chars, CASE WHEN doc_id % 7 < 2 THEN 'E_SIDECAR_INVALID' END AS error_code FROM documents""")
def src_documents(spark, sf):
    """SRC5, SNK1: documents are written one to a file and read back; what isn't a JSON object is an error row."""
    root = _folder(spark)
    docs = view(spark, sf, "documents").selectExpr(f"{_PATH} AS path", f"{_DOC} AS json")
    D.write_documents(docs, root, "overwrite", "path", "json")
    good, bad = D.read_document_tree(spark, root)
    number = F.regexp_extract("path", r"([0-9]+)\.ai\.json$", 1).cast("long").alias("doc_id")
    good = good.select(number, D.get(F.col("doc"), "$.n_chars", "bigint").alias("n_chars"), F.lit(None).cast("string").alias("error_code"))
    return good.union(bad.select(number, F.lit(None).cast("long"), "error_code"))


@query(f"""{ctes("v_progress")} SELECT source_path, status, count(*) AS n, sum(duration_ms)::BIGINT AS duration_ms, min(error_code) AS error_code, 0::BIGINT AS n_broken FROM v_progress GROUP BY 1, 2
UNION ALL SELECT NULL, NULL, count(*), NULL, NULL, count(*) FROM v_progress WHERE event_id % 100 = 0""")
def src_progress(spark, sf):
    """SRC6, SNK3: a log that is appended to twice, with lines that aren't JSON between."""
    root = _folder(spark)
    log = view(spark, sf, "v_progress")
    error = F.struct(F.col("error_code").alias("code"), F.lit("model").alias("stage"), F.lit("").alias("message"), F.lit(True).alias("recoverable"))
    rows = log.select(F.col("ts").cast("timestamp").alias("timestamp"), "source_path", F.col("source_path").alias("relative_path"), F.concat("source_path", F.lit(".ai.json")).alias("sidecar_path"), "status", F.when(F.col("error_code").isNotNull(), F.array(error)).otherwise(F.array()).alias("errors"), "duration_ms", (F.col("event_id") % 2).alias("half"))
    for half in (0, 1):
        D.append_progress(rows.where(F.col("half") == half).drop("half"), root)
    log.where("event_id % 100 = 0").select(F.concat(F.lit("{broken "), F.col("event_id").cast("string"))).write.mode("append").text(root)
    read = D.read_progress(spark, root)
    return read.groupBy("source_path", "status").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("duration_ms"), F.min(F.get("errors", F.lit(0))["code"]).alias("error_code"), F.count("_corrupt_record").alias("n_broken"))


@query(f"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'skipped_existing' WHEN 1 THEN 'written' ELSE 'failed' END AS outcome,
CASE WHEN doc_id % 3 = 1 THEN '{{"new":' || CAST(doc_id AS VARCHAR) || '}}' ELSE {_DOC.replace("STRING", "VARCHAR")} END AS json FROM documents""")
def snk_documents(spark, sf):
    """SNK1: documents that exist are kept, replaced, or fail, by the policy."""
    root = _folder(spark)
    docs = view(spark, sf, "documents").selectExpr("doc_id", f"{_PATH} AS path", f"{_DOC} AS json")
    D.write_documents(docs, root, "overwrite", "path", "json")
    new = docs.withColumn("json", F.concat(F.lit('{"new":'), F.col("doc_id").cast("string"), F.lit("}")))
    done = None
    for k, policy in enumerate(("skip", "overwrite", "fail")):
        said = D.write_documents(new.where(F.col("doc_id") % 3 == k), root, policy, "path", "json")
        done = said if done is None else done.union(said)
    out = f"{root}-outcomes"
    done.write.parquet(out)
    left = D.read_tree(spark, root).select(F.regexp_extract("path", r"([0-9]+)\.ai\.json$", 1).cast("long").alias("doc_id"), F.col("value").alias("json"))
    done = spark.read.parquet(out).select(F.regexp_extract("path", r"([0-9]+)\.ai\.json$", 1).cast("long").alias("doc_id"), "outcome")
    return left.join(done, "doc_id").select("doc_id", "outcome", "json")


@query(f"""{_FILES} SELECT relative_path, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 3 = 0 THEN 'skip' ELSE 'copied' END AS action,
CASE WHEN doc_id % 5 <> 0 AND doc_id % 3 <> 0 THEN sha256(content) END AS sha256 FROM f WHERE NOT {_IGNORED}""")
def snk_copy(spark, sf):
    """SNK5: chosen artifacts are copied into an export tree, with what was done."""
    root = _tree(spark, sf)
    files, _errors = scan_inventory(spark, root, recursive=True)
    each = files.join(_contents(spark, sf).select("relative_path", "doc_id"), "relative_path")
    artifacts = each.where("doc_id % 5 <> 0").select(F.col("relative_path").alias("artifact_key"), F.col("path").alias("cache_path"))
    targets = each.select(F.col("relative_path").alias("artifact_key"), F.concat(F.lit(f"{root}-export/"), "relative_path").alias("target_path"), (F.col("doc_id") % 3 == 0).alias("exists"))
    done = f"{root}-copied"
    D.copy_files(L.copy_plan(artifacts, targets)).select("artifact_key", "action").write.parquet(done)
    there = I.file_identity(scan_inventory(spark, f"{root}-export", recursive=True)[0]).select(F.col("relative_path").alias("artifact_key"), F.col("identity.sha256").alias("sha256"))
    return spark.read.parquet(done).join(there, "artifact_key", "left").select(F.col("artifact_key").alias("relative_path"), "action", "sha256")


@query(f"""{ctes("v_vocabulary")} SELECT canonical_path, parent_path, flat_keyword, synonym, requires_review, auto_apply_allowed, exclusive_group AS mutually_exclusive_group,
true AS export_flat_keyword, true AS export_hierarchical_keyword FROM v_vocabulary""")
def voc_load(spark, sf):
    """VOC1: the vocabulary as one document, and its entries with defaults."""
    root = _folder(spark)
    entry = F.struct("canonical_path", "parent_path", "flat_keyword", F.array("synonym").alias("synonyms"), "requires_review", "auto_apply_allowed", F.col("exclusive_group").alias("mutually_exclusive_group"))
    doc = view(spark, sf, "v_vocabulary").groupBy(F.lit("image-vocabulary/1.3").alias("schema_version")).agg(F.collect_list(entry).alias("entries"))  # a vocabulary is one document
    doc.select(F.to_json(F.struct("schema_version", "entries")).alias("value")).coalesce(1).write.text(root)
    entries, _digest = V.load_vocabulary(spark, root)
    return entries.select("canonical_path", "parent_path", "flat_keyword", F.col("synonyms")[0].alias("synonym"), "requires_review", "auto_apply_allowed", "mutually_exclusive_group", "export_flat_keyword", "export_hierarchical_keyword")
