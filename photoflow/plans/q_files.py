"""Inventory, identity and planning queries (SRC, FLT, IDN, PLN, SNK)."""

import uuid

from pyspark.sql import functions as F

from photoflow.functions import identity as I
from photoflow.functions import paths as P
from photoflow.operators import planning as L
from photoflow.plans.fixtures import ctes, view
from photoflow.plans.registry import query
from photoflow.sources import documents as D
from photoflow.sources.parts import read_headers, read_items
from photoflow.sources.shared import shared_dir

_NAME = "regexp_extract(relative_path, '[^/]*$')"
_EXT = f"regexp_extract({_NAME}, '\\.([^.]*)$', 1)"
_RAW = "('nef','nrw','cr3','cr2','arw','raf','orf','rw2','dng')"
_TYPES = "('nef','nrw','cr3','cr2','arw','raf','orf','rw2','dng','jpg','jpeg','tif','tiff','heic','png')"
_IGNORED = f"(len(list_filter(string_split(relative_path, '/'), lambda p: starts_with(p, '.'))) > 0 OR lower({_NAME}) = '.ds_store' OR ends_with(lower({_NAME}), '.ai.json') OR ends_with(lower({_NAME}), '.xmp'))"
_INV = ctes("v_inventory")
_PLAN = f"""{ctes("v_inventory", "v_existing")},
img AS (SELECT *, relative_path || '.ai.json' AS sidecar_path FROM v_inventory WHERE NOT {_IGNORED} AND lower({_EXT}) IN {_TYPES}),
many AS (SELECT lower(sidecar_path) AS k FROM img GROUP BY 1 HAVING count(*) > 1),
entries AS (SELECT * FROM img WHERE lower(sidecar_path) NOT IN (SELECT k FROM many)),
hit AS (SELECT * FROM img WHERE lower(sidecar_path) IN (SELECT k FROM many)),
ex AS (SELECT DISTINCT sidecar_path FROM v_existing)"""


def inventory(spark, sf):
    return view(spark, sf, "v_inventory")


def images(spark, sf):
    return L.split_supported(inventory(spark, sf))[0].withColumn("sidecar_path", P.document_path(F.col("relative_path")))


@query(f"{_INV} SELECT doc_id, {_IGNORED} AS ignored, CASE WHEN lower({_EXT}) IN {_TYPES} THEN lower({_EXT}) END AS detected_type, coalesce(lower({_EXT}) IN {_RAW}, false) AS raw, "
       f"relative_path || '.ai.json' AS sidecar_path, 'out/' || relative_path || '.ai.json' AS mirrored_path, relative_path || '.model-input.whole_image.jpg' AS export_path, "
       f"CASE WHEN starts_with(relative_path, 'roll01/') THEN substr(relative_path, 8) ELSE {_NAME} END AS below_roll01 FROM v_inventory")  # fmt: skip
def flt_paths(spark, sf):
    """FLT1, FLT2, FLT3, FLT5, FLT6, FLT8, FLT9."""
    p = F.col("relative_path")
    kind = P.detected_type(P.extension(p))
    return inventory(spark, sf).select(
        "doc_id", P.is_ignored(p).alias("ignored"), kind.alias("detected_type"), F.coalesce(P.is_raw(kind), F.lit(False)).alias("raw"), P.document_path(p).alias("sidecar_path"),
        P.document_path(p, "out/").alias("mirrored_path"), P.export_path(p, F.lit("whole_image"), "jpg", "model-input").alias("export_path"), P.relative_path(p, "roll01").alias("below_roll01"),
    )


@query(f"{_INV} SELECT relative_path, 'E_UNSUPPORTED_FORMAT' AS code, true AS recoverable, count(*) AS n FROM v_inventory WHERE NOT {_IGNORED} AND lower({_EXT}) NOT IN {_TYPES} GROUP BY 1")
def flt_unsupported(spark, sf):
    """FLT4."""
    return L.split_supported(inventory(spark, sf))[1].groupBy("relative_path", F.col("error.code").alias("code"), F.col("error.recoverable").alias("recoverable")).agg(F.count("*").alias("n"))


@query(f"{_INV}, d AS (SELECT DISTINCT relative_path FROM v_inventory) SELECT relative_path, CAST(row_number() OVER (ORDER BY lower(relative_path), relative_path) AS BIGINT) AS place FROM d")
def flt_order(spark, sf):
    """FLT7: the place in case-folded order."""
    return L.places(inventory(spark, sf).select("relative_path").distinct(), "relative_path")


@query(f"{_PLAN}, r AS (SELECT doc_id, unnest(['whole_image', 'subject_isolated']) AS role, doc_id % 3 AS position FROM img), t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, role ORDER BY position) AS n FROM r)"
       " SELECT doc_id, role, CAST(CASE role WHEN 'whole_image' THEN 0 ELSE 1 END AS INT) AS input_order FROM t WHERE n = 1")  # fmt: skip
def flt_roles(spark, sf):
    """FLT10, FLT11: roles of mode both, and the first derivative of each."""
    df = L.explode_roles(images(spark, sf).select("doc_id"), "both").withColumn("position", F.col("doc_id") % 3)
    return L.model_inputs(df, "both", image="doc_id").select("doc_id", "role", "input_order")


@query(f"{ctes('v_progress')} SELECT event_id, CASE WHEN status = 'failed' THEN 'error' ELSE 'warn' END AS level FROM v_progress WHERE status IN ('failed', 'skipped_existing')")
def flt_log(spark, sf):
    """FLT12."""
    df = view(spark, sf, "v_progress").select("event_id", L.level_of_status(F.col("status")).alias("level"))
    return L.filter_log(df, "warn")


_VERSIONS = "CASE doc_id % 5 WHEN 0 THEN 'image-json/1.2' WHEN 1 THEN 'image-json/2.0' WHEN 2 THEN 'other/1.2' WHEN 3 THEN 'image-json/1.x' ELSE NULL END"


@query(f"SELECT doc_id, doc_id % 5 = 0 AS accepted FROM (SELECT doc_id, {_VERSIONS} AS v FROM documents)")
def flt_version_gate(spark, sf):
    """FLT13."""
    ok, bad = L.gate_version(view(spark, sf, "documents").select("doc_id", F.expr(_VERSIONS).alias("schema_version")))
    return ok.select("doc_id", F.lit(True).alias("accepted")).union(bad.where("error.code = 'E_SCHEMA_UNSUPPORTED'").select("doc_id", F.lit(False)))


@query(f"{_INV} SELECT count(*) AS n_files FROM v_inventory WHERE lower({_EXT}) = 'xmp'")
def flt_extension_guard(spark, sf):
    """FLT15."""
    return L.count_extension(inventory(spark, sf), "xmp")


_FAST = "sha256('photoflow-identity-fast-us-v1' || chr(10) || 'size:' || CAST(file_size AS VARCHAR) || chr(10) || 'modified_at_ns:' || CAST((1700000000 + doc_id) * 1000000000 AS VARCHAR) || chr(10) || 'first_4m_sha256:' || sha256(substr(content, 1, 64)) || chr(10) || 'last_4m_sha256:' || sha256(right(content, 64)) || chr(10))"


@query(f"""{_INV} SELECT doc_id, sha256(content) AS sha256, {_FAST} AS fast,
  sha256(regexp_replace(regexp_replace(content, '\\r\\n?', chr(10), 'g'), '\\n+$', '') || chr(10)) AS text_sha256,
  sha256(content) || '-render-v2-p-whole_image.jpg' AS artifact_key FROM v_inventory""")
def idn_hashes(spark, sf):
    """IDN1, IDN2, IDN3, IDN5."""
    c = F.col("content")
    fast = I.fast_identity(c, F.col("file_size"), F.timestamp_seconds(1700000000 + F.col("doc_id")), window=64)
    return inventory(spark, sf).select("doc_id", I.content_sha256(c).alias("sha256"), fast.alias("fast"), I.text_identity(c).alias("text_sha256"), I.artifact_key(I.content_sha256(c), I.recipe_version(F.lit("p")), F.lit("whole_image"), F.lit("jpg")).alias("artifact_key"))


_PROMPT = "CASE doc_id % 3 WHEN 0 THEN 'PROMPT_VERSION: ' || CAST(doc_id AS STRING) || chr(10) || text WHEN 1 THEN 'PROMPT_VERSION: v2 ' ELSE text END"


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CAST(doc_id AS VARCHAR) WHEN 1 THEN 'v2' END AS version FROM documents")
def idn_header(spark, sf):
    """IDN4."""
    return view(spark, sf, "documents").select("doc_id", I.header_version(F.expr(_PROMPT)).alias("version"))


@query(f"{_INV} SELECT sha256(content) || '-r-whole_image.jpg' AS artifact_key, min(relative_path) AS first_path, count(*) AS n_sources FROM v_inventory GROUP BY 1")
def idn_artifacts(spark, sf):
    """IDN6."""
    return I.distinct_artifacts(inventory(spark, sf).select("relative_path", I.artifact_key(I.content_sha256(F.col("content")), F.lit("r"), F.lit("whole_image"), F.lit("jpg")).alias("artifact_key")))


@query("SELECT o_orderkey, 'render-v2-p-subject-v2-margin-' || format('{:.6f}', o_orderkey % 100 / 1000.0) || '-merge-' || format('{:.6f}', o_custkey % 10 / 10.0) || '-matte-128-' || CAST(o_orderkey % 256 AS VARCHAR) || '-0' AS recipe FROM orders")
def idn_recipe(spark, sf):
    """IDN7."""
    m = F.array(F.lit(128), (F.col("o_orderkey") % 256).cast("int"), F.lit(0))
    r = I.subject_recipe_version(I.recipe_version(F.lit("p")), (F.col("o_orderkey") % 100).cast("double") / 1000, (F.col("o_custkey") % 10).cast("double") / 10, m)
    return view(spark, sf, "orders").select("o_orderkey", r.alias("recipe"))


@query(f"{_PLAN} SELECT lower(sidecar_path) AS collision_key, min(sidecar_path) AS path, list_aggregate(list_sort(list(relative_path)), 'string_agg', ', ') AS sources FROM hit GROUP BY 1")
def pln_collisions(spark, sf):
    """PLN1, the collisions."""
    return L.collision_groups(L.plan_outputs(images(spark, sf))[1]).select("collision_key", "path", F.array_join("sources", ", ").alias("sources"))


_EXPORTS = "SELECT relative_path, role, relative_path || CASE WHEN doc_id % 7 = 0 THEN '' ELSE CAST(doc_id AS STRING) END || '.' || role AS export_path FROM img CROSS JOIN (VALUES ('whole_image'), ('subject_isolated')) r(role)"


@query(f"""{_PLAN}, x AS ({_EXPORTS}), m AS (SELECT lower(export_path) AS k FROM x GROUP BY 1 HAVING count(*) > 1),
bad AS (SELECT DISTINCT relative_path, lower(export_path) AS k FROM x WHERE lower(export_path) IN (SELECT k FROM m))
SELECT relative_path, export_path AS output, 'planned' AS outcome FROM x WHERE relative_path NOT IN (SELECT relative_path FROM bad)
UNION ALL SELECT relative_path, k, 'failed' FROM bad""")
def pln_exports(spark, sf):
    """PLN2: any collision drops the source; a source in two groups fails twice."""
    x = L.explode_roles(images(spark, sf), "both").withColumn("export_path", F.expr("relative_path || CASE WHEN doc_id % 7 = 0 THEN '' ELSE CAST(doc_id AS STRING) END || '.' || role"))
    ok, bad = L.plan_exports(x)
    return ok.select("relative_path", F.col("export_path").alias("output"), F.lit("planned").alias("outcome")).union(bad.select("relative_path", "collision_key", F.lit("failed")))


def archive(spark, sf):
    name = f"archive_{uuid.uuid4().hex}"
    return L.archive_outputs(view(spark, sf, "v_existing"), name, 16, location=f"{shared_dir(spark)}/{name}")


@query(f"""{_PLAN} SELECT doc_id, CASE WHEN sidecar_path IN (SELECT sidecar_path FROM ex) THEN 'skip_existing' ELSE 'write' END AS skip, CASE WHEN sidecar_path IN (SELECT sidecar_path FROM ex) THEN 'fail_existing' ELSE 'write' END AS fail,
'write' AS overwrite, 'dry_run' AS dry FROM entries""")
def pln_existing(spark, sf):
    """PLN3, PLN4: all policies from one join with an archive whose buckets the plan is dealt out to."""
    out = L.with_existing(L.plan_outputs(images(spark, sf))[0].select("doc_id", "sidecar_path"), archive(spark, sf))
    policies = {"skip": L.existing_action("skip"), "fail": L.existing_action("fail"), "overwrite": L.existing_action("overwrite"), "dry": L.existing_action("fail", dry_run=True)}
    return out.select("doc_id", *[c.alias(name) for name, c in policies.items()])


@query(f"{_PLAN} SELECT doc_id, sidecar_path FROM entries WHERE sidecar_path NOT IN (SELECT sidecar_path FROM ex)")
def pln_pending(spark, sf):
    """PLN5, against an archive that isn't shuffled."""
    return L.pending_work(L.plan_outputs(images(spark, sf))[0], archive(spark, sf)).select("doc_id", "sidecar_path")


@query(f"""{_PLAN}, o AS (
SELECT 0 AS stage_rank, relative_path AS path, 'failed' AS status, 'E_UNSUPPORTED_FORMAT' AS error_code, CAST(NULL AS VARCHAR) AS sha256 FROM v_inventory WHERE NOT {_IGNORED} AND lower({_EXT}) NOT IN {_TYPES}
UNION ALL SELECT 1, relative_path, 'failed', 'E_SIDECAR_COLLISION', NULL FROM hit
UNION ALL SELECT 2, relative_path, CASE WHEN sidecar_path IN (SELECT sidecar_path FROM ex) THEN 'skipped_existing' ELSE 'planned' END, NULL, sha256(content) FROM entries)
SELECT CAST(stage_rank AS INT) AS stage_rank, status, coalesce(error_code, '') AS error_code, count(*) AS n, count(DISTINCT sha256) AS n_contents, min(path) AS first_path FROM o GROUP BY 1, 2, 3""")
def pln_outcomes(spark, sf):
    """The minimum slice: which files would be written, skipped or fail, and why (FLT1-FLT8, IDN1, PLN1, PLN3, PLN6, AGG1)."""
    errors = L.split_supported(inventory(spark, sf))[1]
    entries, collisions = L.plan_outputs(images(spark, sf))
    entries = L.apply_existing(entries, view(spark, sf, "v_existing"), "skip")
    sha = entries.select(F.col("relative_path").alias("path"), F.lit(2).alias("stage_rank"), I.content_sha256(F.col("content")).alias("sha256"))
    out = L.union_outcomes(errors, collisions, entries).join(sha, ["path", "stage_rank"], "left")
    return out.groupBy("stage_rank", "status", F.coalesce("error_code", F.lit("")).alias("error_code")).agg(F.count("*").alias("n"), F.count_distinct("sha256").alias("n_contents"), F.min("path").alias("first_path"))


@query("SELECT doc_id, '{\"a\":{\"k\":' || CAST(doc_id AS VARCHAR) || ',\"z\":null},\"b\":[2,1]}' AS json FROM documents")
def snk_canonical(spark, sf):
    """SNK2."""
    text = F.expr("'{\"b\":[2,1],\"a\":{\"z\":null, \"k\": ' || CAST(doc_id AS STRING) || '}}'")
    return view(spark, sf, "documents").select("doc_id", D.canonical_json(F.parse_json(text)).alias("json"))


@query(f"""{_PLAN}, e AS (SELECT camera AS run_id, relative_path, CASE doc_id % 4 WHEN 0 THEN 'exported' WHEN 1 THEN 'skipped' WHEN 2 THEN 'partial' ELSE 'failed' END AS status FROM entries),
t AS (SELECT run_id, count(*) AS total, count(CASE WHEN status = 'exported' THEN 1 END) AS exported, count(CASE WHEN status = 'failed' THEN 1 END) AS failed FROM e GROUP BY 1)
SELECT run_id, total, exported, failed, relative_path, status, role, relative_path || '.' || role AS output, CASE role WHEN 'whole_image' THEN 'copy' ELSE 'skip' END AS action FROM e JOIN t USING (run_id) CROSS JOIN (VALUES ('whole_image'), ('subject_isolated')) r(role)""")
def snk_manifest(spark, sf):
    """SNK4: a manifest per run, written in parts and read back, each record with its nested outputs."""
    status = F.expr("CASE doc_id % 4 WHEN 0 THEN 'exported' WHEN 1 THEN 'skipped' WHEN 2 THEN 'partial' ELSE 'failed' END")
    e = L.explode_roles(L.plan_outputs(images(spark, sf))[0], "both")
    e = e.select(F.col("camera").alias("run_id"), "relative_path", status.alias("status"), "role", F.concat("relative_path", F.lit("."), "role").alias("output"), F.when(F.col("role") == "whole_image", "copy").otherwise("skip").alias("action"))
    path = f"{shared_dir(spark)}/manifests-{uuid.uuid4().hex}"
    D.write_export_manifests(e, path)
    head = read_headers(spark, path, "run_id string, total long, exported long, failed long")
    item = read_items(spark, path, "relative_path string, status string, outputs array<struct<role:string,output:string,action:string>>", "run_id")
    return item.select("run_id", "item.*").join(head, "run_id").select("run_id", "total", "exported", "failed", "relative_path", "status", F.inline("outputs"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 3 = 0 THEN 'skip' ELSE 'copy' END AS action FROM documents")
def snk_copy_plan(spark, sf):
    """SNK5, the plan."""
    d = view(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("artifact_key"))
    art = d.where("doc_id % 5 <> 0").select("artifact_key", F.concat(F.lit("cache/"), "artifact_key").alias("cache_path"))
    return L.copy_plan(art, d.withColumns({"target_path": F.col("artifact_key"), "exists": F.col("doc_id") % 3 == 0})).select("doc_id", "action")
