"""Views over the driver's tables in the shapes the operators take; plain SQL for Spark and DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents labels conversations".split()

_EXT = "CASE doc_id % 12 WHEN 0 THEN 'NEF' WHEN 1 THEN 'CR3' WHEN 2 THEN 'JPG' WHEN 3 THEN 'jpeg' WHEN 4 THEN 'nef' WHEN 5 THEN 'cr3' WHEN 6 THEN 'heic' WHEN 7 THEN 'tif' WHEN 8 THEN 'png'"
_NAME = "'roll' || lpad(CAST(doc_id % 398 % 20 AS STRING), 2, '0') || '/_DSC' || lpad(CAST(doc_id % 398 AS STRING), 4, '0') || '.'"

VIEWS = {
    "v_inventory": f"""SELECT doc_id, CASE WHEN doc_id % 29 = 0 THEN '.trash/' ELSE '' END || {_NAME}
        || {_EXT} WHEN 9 THEN 'mp4' WHEN 10 THEN 'ai.json' ELSE 'XMP' END AS relative_path,
        text AS content, n_chars AS file_size, source AS camera FROM documents""",
    "v_existing": f"SELECT i.relative_path || '.ai.json' AS sidecar_path FROM (SELECT doc_id, {_NAME} || {_EXT.replace(chr(32) + 'WHEN 8 THEN ' + chr(39) + 'png' + chr(39), '')} ELSE 'png' END AS relative_path FROM labels) i",
    "v_instances": """SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY ln, pk, sk, price) AS INT) AS idx,
        area_pixels, x, y, w, h, x + w / 2 AS cx, y + h / 2 AS cy
        FROM (SELECT l_orderkey AS image_id, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, l_extendedprice AS price,
        CAST(l_quantity AS BIGINT) * 100 AS area_pixels, abs(l_discount) * 5 AS x, abs(l_tax) * 5 AS y,
        CAST(0.05 AS DOUBLE) + l_quantity / 250 AS w, CAST(0.05 AS DOUBLE) + l_quantity / 200 AS h FROM lineitem) t""",
    "v_images": """SELECT o_orderkey AS image_id, CAST(1000 + o_custkey % 37 * 150 AS INT) AS width, CAST(800 + o_orderkey % 41 * 120 AS INT) AS height,
        CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderkey % 10 AS INT) END AS exif_value,
        CASE o_custkey % 4 WHEN 0 THEN 1024 WHEN 1 THEN 1536 WHEN 2 THEN 2048 ELSE 9999 END AS profile_edge FROM orders""",
    "v_attempts": """SELECT conv_id AS run_id, turn AS attempt_no, CASE WHEN turn = 0 THEN 'primary' ELSE 'repair' END AS kind,
        CASE WHEN conv_id % 2 = 0 THEN 'whole_image' ELSE 'subject_isolated' END AS input_role, length(text) AS duration_ms,
        CASE (conv_id + turn) % 6 WHEN 0 THEN '{"term":"' || substring(md5(text), 1, 8) || '","confidence":"high"}'
        WHEN 1 THEN '```json' || chr(10) || '{"term":"' || substring(md5(text), 1, 8) || '","confidence":"low"}' || chr(10) || '```'
        WHEN 2 THEN '{"term":"' || substring(md5(text), 1, 8) || '","confidence":"certain"}' WHEN 3 THEN '{"term":"' || substring(md5(text), 1, 8)
        WHEN 4 THEN '{"confidence":"medium"}' ELSE '{"term":"x","confidence":"high","camera":1}' END AS raw_text FROM conversations""",
    "v_progress": """SELECT event_id, ts, CAST(user_id % 25 AS INT) AS batch_id,
        'roll' || lpad(CAST(user_id % 20 AS STRING), 2, '0') || '/_DSC' || CAST(event_id % 4000 AS STRING) || '.NEF' AS source_path,
        CASE event_type WHEN 'view' THEN 'written' WHEN 'signup' THEN 'written' WHEN 'click' THEN 'skipped_existing' WHEN 'purchase' THEN 'dry_run' ELSE 'failed' END AS status,
        CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 'E_MODEL_INVALID_JSON' WHEN 1 THEN 'E_MODEL_SCHEMA_VIOLATION' WHEN 2 THEN 'E_SIDECAR_EXISTS' ELSE 'E_DECODE_FAILED' END END AS error_code,
        CAST(floor(value) AS BIGINT) AS duration_ms FROM events""",
    "v_cache": """SELECT CAST(o_custkey % 10 AS INT) AS cache_id, md5(CAST(o_orderkey AS STRING)) || md5(CAST(o_custkey AS STRING)) || '-render-v2-whole_image.jpg' AS file_name,
        CAST(floor(o_totalprice) AS BIGINT) AS byte_count, o_orderdate AS last_accessed_at, o_orderkey AS entry_id FROM orders""",
    "v_bench": """SELECT o_orderkey AS doc_id, CAST(2 + o_custkey % 4 * 2 AS INT) AS stage_concurrency,
        CASE o_custkey % 3 WHEN 0 THEN '0' WHEN 1 THEN '5m' ELSE '30m' END AS model_keep_alive, CAST(floor(o_totalprice / 10) AS BIGINT) AS pipeline_ms,
        CASE WHEN o_orderkey % 50 = 0 AND o_custkey % 4 = 1 THEN 1 ELSE 0 END AS error_count, CASE WHEN o_custkey % 3 = 0 THEN 1000 ELSE 0 END AS load_duration_ns FROM orders""",
    "v_vocabulary": """SELECT 'Place|' || r_name || '|' || n_name AS canonical_path, 'Place|' || r_name AS parent_path, n_name AS flat_keyword, replace(lower(n_name), '_', ' ') AS synonym,
        n_nationkey % 5 = 0 AS requires_review, n_nationkey % 5 <> 0 AS auto_apply_allowed, CASE WHEN n_nationkey % 7 = 0 THEN 'grp' || CAST(n_regionkey AS STRING) END AS exclusive_group
        FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT 'Place|' || r_name, 'Place', r_name, lower(r_name), false, r_regionkey <> 0, CAST(NULL AS STRING) FROM region
        UNION ALL SELECT 'Place', CAST(NULL AS STRING), 'Place', 'place', false, true, CAST(NULL AS STRING) FROM region WHERE r_regionkey = 0""",
    "v_observations": """SELECT c_mktsegment AS session_id, l_orderkey AS image_id,
        CASE WHEN l_linenumber % 2 = 0 THEN '  ' || replace(lower(n_name), '_', '  ') || ' ' ELSE n_name END AS term,
        CASE l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'medium' ELSE 'low' END AS confidence,
        CASE WHEN l_linenumber % 3 = 0 THEN 'subject_isolated' ELSE 'whole_image' END AS input_role
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view ``name``, or a table as it is."""
    for t in TABLES:
        if name == t or t in VIEWS.get(name, ""):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(VIEWS[name]) if name in VIEWS else spark.table(name)


def ctes(*names: str) -> str:
    """``WITH`` clause of these views for oracle SQL."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
