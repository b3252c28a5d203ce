"""Report, calibration and cache queries (AGG, CCH)."""

import uuid

from pyspark.sql import functions as F

from photoflow.operators import cache as C
from photoflow.operators import reports as A
from photoflow.plans.fixtures import ctes, view
from photoflow.plans.registry import query
from photoflow.sources import documents as D
from photoflow.sources.parts import read_headers, read_items
from photoflow.sources.shared import shared_dir

_P = ctes("v_progress")


def progress(spark, sf):
    return view(spark, sf, "v_progress").withColumn("position", F.col("event_id"))


def scanned(spark, sf):
    return view(spark, sf, "v_progress").select("batch_id", "source_path").distinct()


def stopped(spark, sf):
    return view(spark, sf, "v_progress").where("batch_id % 4 = 0").select("batch_id")


@query(f"""{_P}, n AS (SELECT batch_id, count(DISTINCT source_path) AS total_images FROM v_progress GROUP BY 1)
SELECT p.batch_id, any_value(total_images) AS total_images, count(CASE WHEN status = 'written' THEN 1 END) AS written, count(CASE WHEN status = 'skipped_existing' THEN 1 END) AS skipped_existing,
count(CASE WHEN status = 'dry_run' THEN 1 END) AS dry_run, count(CASE WHEN status = 'failed' THEN 1 END) AS failed,
coalesce(string_agg(error_code, ',' ORDER BY event_id), '') || CASE WHEN p.batch_id % 4 = 0 THEN ',E_INTERRUPTED' ELSE '' END AS errors FROM v_progress p JOIN n ON p.batch_id = n.batch_id GROUP BY 1""")
def agg_batch(spark, sf):
    """AGG1."""
    df = A.batch_summary(scanned(spark, sf), progress(spark, sf), stopped(spark, sf))
    return df.withColumn("errors", F.array_join("errors", ","))


@query(f"""{_P}, c AS (SELECT batch_id, count(*) AS n, count(CASE WHEN status = 'failed' THEN 1 END) AS failed FROM v_progress GROUP BY 1)
SELECT batch_id, failed, error_code AS code, event_id AS position FROM v_progress JOIN c USING (batch_id) WHERE error_code IS NOT NULL
UNION ALL SELECT batch_id, failed, 'E_INTERRUPTED', NULL FROM c WHERE batch_id % 4 = 0""")
def agg_batch_document(spark, sf):
    """AGG1 as documents in parts: counts and all errors of a batch, read back."""
    path = f"{shared_dir(spark)}/summaries-{uuid.uuid4().hex}"
    D.write_batch_summaries(scanned(spark, sf), progress(spark, sf), stopped(spark, sf), path)
    head = read_headers(spark, path, "batch_id int, failed long")
    item = read_items(spark, path, "code string, position long", "batch_id").select(F.col("batch_id").cast("int"), "item.*")
    return item.join(head, "batch_id").select("batch_id", "failed", "code", "position")


@query(f"""{_P} SELECT batch_id AS run_id, count(*) AS total, count(CASE WHEN status = 'written' THEN 1 END) AS exported, count(CASE WHEN status = 'skipped_existing' THEN 1 END) AS skipped,
count(CASE WHEN status = 'dry_run' THEN 1 END) AS partial, count(CASE WHEN status = 'failed' THEN 1 END) AS failed FROM v_progress GROUP BY 1""")
def agg_export(spark, sf):
    """AGG2."""
    s = F.create_map(*[F.lit(x) for x in ("written", "exported", "skipped_existing", "skipped", "dry_run", "partial", "failed", "failed")])
    return A.export_summary(progress(spark, sf).select(F.col("batch_id").alias("run_id"), s[F.col("status")].alias("status")))


_BENCH_RUNS = "SELECT l_orderkey AS doc_id, o_custkey % 6 AS bench_id, l_quantity % 2 = 0 AS json_valid, CAST(l_linenumber % 3 AS INT) AS n_attempts, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_linenumber * 100 END AS load_ns, CAST(floor(l_extendedprice) AS BIGINT) AS duration_ms FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def bench_runs(spark, sf):
    view(spark, sf, "lineitem"), view(spark, sf, "orders")
    return spark.sql(_BENCH_RUNS)


@query(f"""{ctes("v_bench")}, d AS (SELECT o_custkey % 6 AS bench_id, error_count AS n_errors, pipeline_ms FROM v_bench JOIN orders ON doc_id = o_orderkey), r AS ({_BENCH_RUNS}),
a AS (SELECT bench_id, count(*) AS documents, count(CASE WHEN n_errors > 0 THEN 1 END) AS failed_documents, CAST(quantile_disc(pipeline_ms, 0.5 ORDER BY pipeline_ms DESC) AS BIGINT) AS median_pipeline_ms FROM d GROUP BY 1),
b AS (SELECT bench_id, count(*) AS runs, count(CASE WHEN json_valid THEN 1 END) AS valid_runs, sum(greatest(n_attempts - 1, 0))::BIGINT AS repair_attempts, sum(coalesce(load_ns, 0))::BIGINT AS load_ns, CAST(quantile_disc(duration_ms, 0.5 ORDER BY duration_ms DESC) AS BIGINT) AS median_run_ms FROM r GROUP BY 1)
SELECT a.*, runs, valid_runs, repair_attempts, load_ns, median_run_ms FROM a JOIN b ON a.bench_id = b.bench_id""")
def agg_bench(spark, sf):
    """AGG3, AGG5, AGG6."""
    o = view(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 6).alias("bench_id"))
    d = view(spark, sf, "v_bench").select("doc_id", F.col("error_count").alias("n_errors"), "pipeline_ms").join(o, "doc_id")
    return A.bench_metrics(d, bench_runs(spark, sf))


@query(f"""WITH r AS ({_BENCH_RUNS}), e AS (SELECT bench_id, 'E_DOC' AS error_code FROM r WHERE doc_id % 10 = 0 UNION ALL SELECT bench_id, 'E_' || CAST(n_attempts AS VARCHAR) FROM r WHERE NOT json_valid UNION ALL SELECT bench_id, 'E_1' FROM r WHERE load_ns IS NULL)
SELECT bench_id, error_code, count(*) AS n FROM e GROUP BY 1, 2""")
def agg_codes(spark, sf):
    """AGG4."""
    r = bench_runs(spark, sf)
    code = lambda cond, c: r.select("bench_id", F.when(cond, c).alias("error_code"))
    return A.error_code_counts(code(F.col("doc_id") % 10 == 0, F.lit("E_DOC")), code(~F.col("json_valid"), F.concat(F.lit("E_"), F.col("n_attempts").cast("string"))), code(F.col("load_ns").isNull(), F.lit("E_1")))


_REPAIRED = "CASE WHEN batch_id % 3 = 1 AND status = 'failed' THEN 'written' ELSE status END"


@query(f"{_P} SELECT batch_id, bool_and({_REPAIRED} <> 'failed') AND batch_id % 4 <> 0 AS success FROM v_progress GROUP BY 1")
def agg_success(spark, sf):
    """AGG7, over the whole log; in one batch of three what failed was written in the end."""
    p = progress(spark, sf)
    return A.batch_success(p, p.withColumn("status", F.expr(_REPAIRED)), stopped(spark, sf))


@query(f"""{ctes("v_bench")}, g AS (SELECT stage_concurrency, quantile_disc(pipeline_ms, 0.5 ORDER BY pipeline_ms DESC)::DOUBLE AS m, sum(error_count) AS e FROM v_bench GROUP BY 1), k AS (SELECT * FROM g WHERE e = 0)
SELECT min(stage_concurrency) AS stage_concurrency FROM k WHERE m <= (SELECT min(m) FROM k) * 1.05""")
def agg_concurrency(spark, sf):
    """AGG8."""
    return A.calibrate_concurrency(view(spark, sf, "v_bench"))


@query(f"""{ctes("v_bench")}, g AS (SELECT model_keep_alive, sum(load_duration_ns) AS l FROM v_bench GROUP BY 1)
SELECT coalesce(arg_min(model_keep_alive, CASE model_keep_alive WHEN '0' THEN 0 WHEN '5m' THEN 1 ELSE 2 END), '30m') AS model_keep_alive FROM g WHERE l = 0""")
def agg_keep_alive(spark, sf):
    """AGG9."""
    return A.calibrate_keep_alive(view(spark, sf, "v_bench"))


_REQ = "CASE WHEN entry_id % 5 = 0 THEN 'other' ELSE file_name END"


@query(f"""{ctes("v_cache")} SELECT entry_id, CASE WHEN entry_id % 5 = 0 OR entry_id % 3 = 0 OR entry_id % 7 = 0 THEN 'miss' WHEN entry_id % 2 = 0 THEN 'corrupt' ELSE 'hit' END AS result FROM v_cache""")
def cch_probe(spark, sf):
    """CCH1: requests of other names, entries without a file, files without an entry, and changed hashes."""
    v = view(spark, sf, "v_cache")
    entries = v.where("entry_id % 3 <> 0").select("cache_id", "file_name", F.lit("a").alias("sha256"))
    files = v.where("entry_id % 7 <> 0").select("cache_id", "file_name", F.when(F.col("entry_id") % 2 == 0, "b").otherwise("a").alias("sha256"))
    return C.cache_probe(v.select("entry_id", "cache_id", F.expr(_REQ).alias("file_name")), entries, files).select("entry_id", "result")


@query(f"""{ctes("v_cache")}, b AS (SELECT cache_id, file_name, byte_count, last_accessed_at, 0 AS n FROM v_cache UNION ALL SELECT cache_id, CASE WHEN entry_id % 2 = 0 THEN file_name ELSE 'new' || CAST(entry_id AS VARCHAR) END, byte_count + 1, last_accessed_at, 1 FROM v_cache WHERE entry_id % 3 = 0)
SELECT cache_id, file_name, arg_max(byte_count, n) AS byte_count FROM b GROUP BY 1, 2""")
def cch_upsert(spark, sf):
    """CCH2."""
    v = view(spark, sf, "v_cache").drop("entry_id")
    new = view(spark, sf, "v_cache").where("entry_id % 3 = 0").select("cache_id", F.expr("CASE WHEN entry_id % 2 = 0 THEN file_name ELSE 'new' || CAST(entry_id AS STRING) END").alias("file_name"), (F.col("byte_count") + 1).alias("byte_count"), "last_accessed_at")
    return C.cache_upsert(v, new).select("cache_id", "file_name", "byte_count")


@query(f"""{ctes("v_cache")}, k AS (SELECT *, entry_id % 100 = 0 AS keep FROM v_cache),
w AS (SELECT *, sum(byte_count) OVER (PARTITION BY cache_id) AS total, coalesce(sum(CASE WHEN NOT keep THEN byte_count END) OVER (PARTITION BY cache_id ORDER BY last_accessed_at, file_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM k)
SELECT entry_id, NOT keep AND total - gone > 20000000 AS evict FROM w""")
def cch_evict(spark, sf):
    """CCH3."""
    v = view(spark, sf, "v_cache")
    return C.lru_evict(v, 20_000_000, v.where("entry_id % 100 = 0")).select("entry_id", "evict")


@query(f"""{ctes("v_cache")}, f AS (SELECT cache_id, entry_id, CASE entry_id % 4 WHEN 0 THEN file_name WHEN 1 THEN 'manifest.json' WHEN 2 THEN 'notes.txt' ELSE md5(file_name) || md5(file_name) || '-r-subject_isolated.tiff' END AS file_name FROM v_cache)
SELECT cache_id, count(*) AS removed FROM f WHERE entry_id % 4 <> 2 OR entry_id % 6 = 0 GROUP BY 1""")
def cch_purge(spark, sf):
    """CCH4, CCH5: entries that are known under a plain name go as well."""
    v = view(spark, sf, "v_cache")
    name = F.expr("CASE entry_id % 4 WHEN 0 THEN file_name WHEN 1 THEN 'manifest.json' WHEN 2 THEN 'notes.txt' || CASE WHEN entry_id % 6 = 0 THEN CAST(entry_id AS STRING) ELSE '' END ELSE md5(file_name) || md5(file_name) || '-r-subject_isolated.tiff' END")
    files = v.select("cache_id", "entry_id", name.alias("file_name"))
    return C.purge_summary(C.purge_candidates(files, files.where("entry_id % 6 = 0").select("cache_id", "file_name")))
