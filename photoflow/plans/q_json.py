"""JSON column and run queries (JSN, RUN, PLN7, FLT14)."""

import json

from pyspark.sql import functions as F

from photoflow.functions import json_schema as J
from photoflow.operators import runs as R
from photoflow.plans.fixtures import ctes, view
from photoflow.plans.registry import query
from photoflow.sources import documents as D

SCHEMA = {"type": "object", "additionalProperties": False, "required": ["term", "confidence"], "properties": {"term": {"type": "string", "minLength": 1}, "confidence": {"type": "string", "enum": J.BANDS}}}
_ATT = f"""{ctes("v_attempts")},
s AS (SELECT *, CASE WHEN starts_with(raw_text, '```') THEN regexp_replace(regexp_replace(raw_text, '^```[^\\n]*\\n', ''), '\\n?```\\s*$', '') ELSE raw_text END AS body FROM v_attempts),
j AS (SELECT *, json_valid(body) AS ok FROM s),
c AS (SELECT *, CASE WHEN NOT ok THEN 'invalid_json' WHEN json_extract_string(body, '$.term') IS NOT NULL AND json_extract_string(body, '$.confidence') IN ('high', 'medium', 'low') AND len(json_keys(CASE WHEN ok THEN body ELSE '{{}}' END)) = 2 THEN 'valid' ELSE 'schema_violation' END AS status FROM j)"""


def attempts(spark, sf):
    c = J.classify_response(F.col("raw_text"), SCHEMA)
    return view(spark, sf, "v_attempts").withColumn("c", c)


@query(f"{_ATT} SELECT run_id, attempt_no, body, status, CASE status WHEN 'invalid_json' THEN 'E_MODEL_INVALID_JSON' WHEN 'schema_violation' THEN 'E_MODEL_SCHEMA_VIOLATION' END AS error_code, CASE WHEN ok THEN json_extract_string(body, '$.confidence') END AS confidence FROM c")
def jsn_classify(spark, sf):
    """JSN1, JSN2, JSN3, JSN4 on attempts."""
    return attempts(spark, sf).select("run_id", "attempt_no", J.strip_fence(F.col("raw_text")).alias("body"), "c.status", "c.error_code", F.try_variant_get("c.parsed", "$.confidence", "string").alias("confidence"))


# one mutation of a valid value by id, and what it violates first
RULES = {
    "type": "object", "required": ["a", "n"], "additionalProperties": False,
    "properties": {
        "a": {"type": "array", "minItems": 1, "maxItems": 3, "contains": {"type": "string", "enum": ["k"]}, "items": {"$ref": "#/$defs/i~1tem"}},
        "n": {"type": ["integer", "null"], "not": {"enum": [13]}}, "s": {"type": "string", "minLength": 2, "maxLength": 4, "pattern": "^[a-z]+$"}, "m": {"type": "object", "additionalProperties": {"type": "boolean"}},
        "c": {"if": {"type": "object", "required": ["x"]}, "then": {"required": ["y"]}, "else": {"type": "string"}}, "l": {"allOf": [{"minLength": 1}, {"maxLength": 2}]}, "e": {"enum": [1, True, None, {"q": [1]}]},
    },
    "$defs": {"i/tem": {"type": "string", "maxLength": 1, "ignored": True}},
}
CASES = [
    ('{"a":["k"],"n":1.0}', None, None), ('{"a":["k"],"n":null,"s":"ab","m":{"t":true},"c":{"x":1,"y":2},"l":"z","e":{"q":[1]}}', None, None), ("[1]", "$", "type"), ('{"a":["k"]}', "$", "required"),
    ('{"a":["k"],"n":1,"zz":1,"b":1}', "$.b", "additionalProperties"), ('{"a":[],"n":1}', "$.a", "minItems"), ('{"a":["k","b","c","d"],"n":1}', "$.a", "maxItems"), ('{"a":["b"],"n":1}', "$.a", "contains"),
    ('{"a":["k",2],"n":1}', "$.a[1]", "type"), ('{"a":["k","long"],"n":1}', "$.a[1]", "maxLength"), ('{"a":["k"],"n":1.5}', "$.n", "type"), ('{"a":["k"],"n":13}', "$.n", "not"), ('{"a":["k"],"n":1,"s":"a"}', "$.s", "minLength"),
    ('{"a":["k"],"n":1,"s":"abcde"}', "$.s", "maxLength"), ('{"a":["k"],"n":1,"s":"AB"}', "$.s", "pattern"), ('{"a":["k"],"n":1,"m":{"t":true,"u":1}}', "$.m.u", "type"), ('{"a":["k"],"n":1,"c":{"x":1}}', "$.c", "required"),
    ('{"a":["k"],"n":1,"c":3}', "$.c", "type"), ('{"a":["k"],"n":1,"l":""}', "$.l", "minLength"), ('{"a":["k"],"n":1,"l":"abc"}', "$.l", "maxLength"), ('{"a":["k"],"n":1,"e":2}', "$.e", "enum"), ('{"a":["k"],"n":1,"e":true}', None, None),
    ('{"a":["k"],"n":1,"e":1.0}', None, None), ('{"a":["k"],"n":1,"e":"1"}', "$.e", "enum"), ('{"a":null,"n":1}', "$.a", "type"),
]


def _lit(x):
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


_TABLE = ", ".join(f"({i}, {_lit(j)}, {_lit(p)}, {_lit(k)})" for i, (j, p, k) in enumerate(CASES))


@query(f"SELECT doc_id, p AS path, k AS keyword, p IS NULL AS valid FROM documents JOIN (VALUES {_TABLE}) t(i, j, p, k) ON i = doc_id % {len(CASES)}")
def jsn_keywords(spark, sf):
    """JSN4a-JSN4q: each keyword on a mutated value per document."""
    cases = F.create_map(*[x for i, (j, _, _) in enumerate(CASES) for x in (F.lit(i), F.lit(j))])
    df = view(spark, sf, "documents").select("doc_id", F.parse_json(cases[(F.col("doc_id") % len(CASES)).cast("int")]).alias("v"))
    df = df.withColumns({"first": J.first_violation(F.col("v"), RULES), "valid": J.matches_schema(F.col("v"), RULES)})
    return df.select("doc_id", "first.path", "first.keyword", "valid")


def whole_response(**changes):
    item = {"term": "owl", "confidence": "high", "evidence": "seen"}
    base = {"summary": "s", "genre_or_photography_type": [{**item, "term": "wildlife"}], "species": [item], "main_subjects": [item], "secondary_subjects": [], "scene_context": [{"term": "t", "confidence": "low"}], "habitat_or_setting": [], "behavior_or_action": [], "proposed_keywords": [], "uncertainty_notes": ""}
    return {k: v for k, v in (base | changes).items() if v is not ...}


RESPONSES = [
    (whole_response(), True), (whole_response(species=...), False), (whole_response(species=[]), True), (whole_response(genre_or_photography_type=[{"term": "food", "confidence": "low", "evidence": "e"}]), False),
    (whole_response(genre_or_photography_type=[{"term": "food", "confidence": "low", "evidence": "e"}], species=...), True), (whole_response(main_subjects=["owl"]), False), (whole_response(main_subjects=[{"term": "owl", "confidence": "certain", "evidence": "e"}]), False),
    (whole_response(main_subjects=[{"term": "owl", "confidence": "high"}]), False), (whole_response(summary=...), False), (whole_response(extra=1), False), (whole_response(summary="x" * 281), False), (whole_response(proposed_keywords=[{"term": "a\nb", "confidence": "low", "evidence": "e"}]), False),
    (whole_response(genre_or_photography_type=[{"term": "birds", "confidence": "low", "evidence": "e"}], species=...), False), (whole_response(genre_or_photography_type=[{"term": "food", "confidence": "low", "evidence": "e"}] * 5, species=...), False),
]
_ROLE = "CASE WHEN doc_id % 2 = 0 THEN 'whole_image' ELSE 'subject_isolated' END"
_VALID = ", ".join(f"({i}, {str(ok).lower()})" for i, (_, ok) in enumerate(RESPONSES))
_SPECIES = [("species" in r) == any(g.get("term") in J.SPECIES_GENRES for g in r["genre_or_photography_type"]) for r, _ in RESPONSES]
_RULE = ", ".join(f"({i}, {str(ok).lower()})" for i, ok in enumerate(_SPECIES))


@query(f"SELECT doc_id, {_ROLE} AS role, a.ok AND doc_id % 2 = 0 AS valid, b.ok AS species_rule FROM documents JOIN (VALUES {_VALID}) a(i, ok) ON a.i = doc_id % {len(RESPONSES)} JOIN (VALUES {_RULE}) b(i, ok) ON b.i = a.i")
def jsn_roles(spark, sf):
    """JSN5, JSN6: responses against the schema of their role; those of whole images don't fit a subject's."""
    cases = F.array(*[F.lit(json.dumps(r)) for r, _ in RESPONSES])
    df = view(spark, sf, "documents").select("doc_id", F.expr(_ROLE).alias("role"), F.parse_json(F.get(cases, (F.col("doc_id") % len(RESPONSES)).cast("int"))).alias("v"))
    return df.select("doc_id", "role", (F.size(J.violations_by_role(F.col("v"), F.col("role"))) == 0).alias("valid"), J.species_rule(F.col("v")).alias("species_rule"))


@query("SELECT doc_id AS path, CASE WHEN doc_id % 3 = 2 THEN '{\"a\":{\"keep\":1,\"x\":1},\"l\":[1,{\"p\":1}]}' ELSE '{\"a\":{\"keep\":1,\"x\":' || CAST(doc_id AS VARCHAR) || '},\"l\":[' || CAST(doc_id AS VARCHAR) || '],\"new\":true}' END AS json FROM documents")
def jsn_merge(spark, sf):
    """JSN7."""
    d = view(spark, sf, "documents").select(F.col("doc_id").alias("path"))
    base = d.withColumn("json", F.lit('{"a":{"keep":1,"x":1},"l":[1,{"p":1}]}'))
    new = d.where("path % 3 <> 2").withColumn("json", F.expr("""'{"a":{"x":' || CAST(path AS STRING) || '},"l":[' || CAST(path AS STRING) || '],"new":true}'"""))
    return D.merge_documents(base, new)


_DOC = """'{"run_configuration":{' || CASE WHEN doc_id % 2 = 0 THEN '"response_repair_attempts":' || CAST(doc_id % 4 AS STRING) ELSE '' END || '},"subject_isolation":' || CASE WHEN doc_id % 3 = 0 THEN '{}' ELSE '{"status":"success"}' END
 || CASE WHEN doc_id % 5 = 0 THEN '' ELSE ',"timing":{"pipeline_ms":"' || CAST(doc_id AS STRING) || '"}' END || ',"errors":[{"code":"E_A","stage":"scan"}],"model_runs":[{"json_valid":true,"duration_ms":4,"metrics":{"load_duration_ns":1000}},{"json_valid":false,"duration_ms":"x","attempts":[1,2]}]}'"""


def documents(spark, sf):
    return view(spark, sf, "documents").select("doc_id", F.parse_json(F.expr(_DOC)).alias("doc"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id % 4 ELSE 1 END AS repair_attempts, CASE WHEN doc_id % 5 <> 0 THEN doc_id END AS pipeline_ms, CASE WHEN doc_id % 3 <> 0 THEN 'success' END AS isolation_status FROM documents")
def flt_defaults(spark, sf):
    """FLT14, JSN9."""
    return D.fill_defaults(documents(spark, sf)).drop("doc")


@query("""SELECT doc_id, 0 AS position, true AS json_valid, 4::BIGINT AS duration_ms, 1000::BIGINT AS load_ns, 0 AS n_attempts, 'E_A' AS error_code FROM documents
UNION ALL SELECT doc_id, 1, false, NULL, NULL, 2, 'E_A' FROM documents""")
def jsn_explode(spark, sf):
    """JSN8, JSN9."""
    d = documents(spark, sf)
    e = D.explode_errors(d).select("doc_id", "error_code")
    return D.explode_runs(d).select("doc_id", "position", "json_valid", "duration_ms", "load_ns", "n_attempts").join(e, "doc_id")


@query(f"""{_ATT}, t AS (SELECT run_id, attempt_no, CASE WHEN run_id % 7 = 0 AND attempt_no = 1 THEN 'E_MODEL_TIMEOUT' END AS transport, CASE WHEN run_id % 7 = 0 AND attempt_no = 1 THEN NULL ELSE status END AS status, row_number() OVER (PARTITION BY run_id ORDER BY attempt_no) AS n FROM c),
k AS (SELECT *, CASE WHEN status = 'valid' THEN n END AS good, CASE WHEN transport IS NULL THEN n END AS done FROM t WHERE n <= 3),
g AS (SELECT run_id, min(good) AS good, max(done) AS done, max(n) AS last, count(*) AS cnt, arg_max(transport IS NOT NULL, n) AS last_transport FROM k GROUP BY 1)
SELECT g.run_id, CAST(k.attempt_no AS BIGINT) AS final_attempt, g.good IS NOT NULL AS json_valid, k.status, CASE WHEN g.good IS NOT NULL THEN NULL WHEN last_transport THEN 'E_MODEL_TIMEOUT' WHEN k.status = 'invalid_json' THEN 'E_MODEL_INVALID_JSON' ELSE 'E_MODEL_SCHEMA_VIOLATION' END AS error_code, cnt AS n_attempts, CASE WHEN cnt > 1 THEN cnt END AS kept_attempts
FROM g JOIN k ON g.run_id = k.run_id AND k.n = coalesce(g.good, g.done, g.last)""")
def run_resolve(spark, sf):
    """RUN1, RUN2, RUN3."""
    bad = (F.col("run_id") % 7 == 0) & (F.col("attempt_no") == 1)
    a = attempts(spark, sf).select("run_id", "attempt_no", F.when(~bad, F.col("c.status")).alias("status"), F.when(~bad, F.col("c.error_code")).alias("error_code"), F.col("raw_text").alias("response"), F.when(bad, "E_MODEL_TIMEOUT").alias("transport_error"))
    df = R.resolve_attempts(a, repair_limit=2)
    return df.select("run_id", "final_attempt", "json_valid", "status", "error_code", "n_attempts", F.when(F.col("attempts").isNotNull(), F.size("attempts").cast("long")).alias("kept_attempts"))


@query(f"""{_ATT} SELECT run_id // 3 AS document_id, CASE WHEN bool_or(run_id % 11 = 0) THEN 'skipped_existing' WHEN bool_or(status = 'valid') THEN 'written' ELSE 'failed' END AS status FROM c GROUP BY 1""")
def run_document_status(spark, sf):
    """RUN4."""
    a = attempts(spark, sf).select(F.expr("run_id div 3").alias("document_id"), (F.col("c.status") == "valid").alias("json_valid"), "c.error_code", (F.col("run_id") % 11 == 0).alias("skip"))
    return R.document_status(a, skipped="skip")


@query(f"""{_ATT}, e AS (SELECT run_id AS document_id, 0 AS part, 0::BIGINT AS pos, 'E_RENDER_FAILED' AS code FROM (SELECT DISTINCT run_id FROM c WHERE run_id % 2 = 0)
UNION ALL SELECT run_id, 1, attempt_no, CASE status WHEN 'invalid_json' THEN 'E_MODEL_INVALID_JSON' ELSE 'E_MODEL_SCHEMA_VIOLATION' END FROM c WHERE status <> 'valid')
SELECT document_id, string_agg(code, ',' ORDER BY part, pos) AS errors FROM e GROUP BY 1""")
def run_document_errors(spark, sf):
    """RUN5."""
    a = attempts(spark, sf)
    prep = a.where("run_id % 2 = 0").select(F.col("run_id").alias("document_id"), F.lit(0).cast("long").alias("position"), F.lit("E_RENDER_FAILED").alias("error_code")).distinct()
    runs = a.select(F.col("run_id").alias("document_id"), F.col("attempt_no").alias("position"), "c.error_code")
    return R.document_errors(prep, runs).select("document_id", F.array_join("errors", ",").alias("errors"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 THEN 'failed' ELSE 'written' END AS subject, CASE WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE 'written' END AS both_modes FROM orders")
def run_prep_status(spark, sf):
    """RUN6."""
    iso, ren = F.when(F.col("o_orderkey") % 5 == 0, "E"), F.when(F.col("o_orderkey") % 3 == 0, "E")
    return view(spark, sf, "orders").select("o_orderkey", R.prep_status("subject", iso, ren).alias("subject"), R.prep_status("both", iso, ren).alias("both_modes"))


@query("""WITH o AS (SELECT l_orderkey AS relative_path, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 1 END AS output, CASE WHEN l_quantity % 2 = 0 THEN 'skip_existing' ELSE 'copy' END AS action, CASE WHEN l_linenumber % 3 = 0 THEN 'E' END AS err FROM lineitem),
g AS (SELECT relative_path, count(output) AS n_outputs, count(err) AS n_errors, count(CASE WHEN output IS NOT NULL AND action = 'skip_existing' THEN 1 END) AS n_skipped FROM o GROUP BY 1)
SELECT *, CASE WHEN n_outputs = 0 THEN 'failed' WHEN n_errors > 0 THEN 'partial' WHEN n_skipped = n_outputs THEN 'skipped' ELSE 'exported' END AS status FROM g""")
def run_export_status(spark, sf):
    """RUN7."""
    bad = F.col("l_linenumber") % 3 == 0
    o = view(spark, sf, "lineitem").select(F.col("l_orderkey").alias("relative_path"), F.when(~bad, 1).alias("output"), F.when(F.col("l_quantity") % 2 == 0, "skip_existing").otherwise("copy").alias("action"), F.when(bad, "E").alias("error_code"))
    return R.export_status(o)


@query("""WITH l AS (SELECT user_id AS request_id, event_id % 4 AS attempt, event_id, CASE event_type WHEN 'error' THEN 'timeout' WHEN 'click' THEN 'refused' WHEN 'purchase' THEN 'ok' ELSE 'timeout' END AS outcome FROM events),
o AS (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY event_id) - 1 AS attempt, outcome FROM l), k AS (SELECT * FROM o WHERE attempt <= 2)
SELECT request_id, count(*) AS n_attempts, CASE WHEN bool_or(outcome = 'ok') THEN NULL WHEN arg_max(outcome, attempt) = 'timeout' THEN 'E_MODEL_TIMEOUT' ELSE 'E_MODEL_RUNTIME_UNREACHABLE' END AS error_code FROM k GROUP BY 1""")
def run_transport(spark, sf):
    """RUN8."""
    from pyspark.sql import Window

    out = F.when(F.col("event_type") == "click", "refused").when(F.col("event_type") == "purchase", "ok").otherwise("timeout")
    log = view(spark, sf, "events").select(F.col("user_id").alias("request_id"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("attempt"), out.alias("outcome"))
    return R.classify_transport(log)


@query("SELECT event_id, greatest(0, CASE WHEN event_id % 3 = 0 THEN -5 ELSE round((event_id * 1499 % 100000) / 1000.0) END)::BIGINT AS ms FROM events")
def run_duration(spark, sf):
    """RUN9."""
    us = F.when(F.col("event_id") % 3 == 0, -5000).otherwise(F.col("event_id") * 1499 % 100000)
    start = F.timestamp_seconds(F.lit(1700000000))
    return view(spark, sf, "events").select("event_id", R.duration_ms(start, F.timestamp_micros(F.unix_micros(start) + us)).alias("ms"))


@query("""WITH rec AS (SELECT doc_id AS position, CASE WHEN doc_id % 2 = 0 THEN 'whole_image' ELSE 'subject_isolated' END AS role, doc_id % 50 AS sha, 'r' || CAST(doc_id AS VARCHAR) AS response FROM documents),
inp AS (SELECT event_id AS input_id, CASE event_id % 3 WHEN 0 THEN 'whole_image' WHEN 1 THEN 'subject_isolated' ELSE 'other' END AS role, event_id % 60 AS sha FROM events),
e AS (SELECT role, sha, arg_min(response, position) AS r FROM rec GROUP BY 1, 2), f AS (SELECT role, arg_min(response, position) AS r FROM rec GROUP BY 1)
SELECT input_id, inp.role, inp.sha, coalesce(e.r, f.r) AS response, CASE WHEN coalesce(e.r, f.r) IS NULL THEN 'E_MODEL_NO_RECORDED_RESULT' END AS error_code FROM inp LEFT JOIN e ON inp.role = e.role AND inp.sha = e.sha LEFT JOIN f ON inp.role = f.role""")
def pln_recorded(spark, sf):
    """PLN7."""
    rec = view(spark, sf, "documents").selectExpr("doc_id AS position", "CASE WHEN doc_id % 2 = 0 THEN 'whole_image' ELSE 'subject_isolated' END AS role", "doc_id % 50 AS sha", "'r' || CAST(doc_id AS STRING) AS response")
    inp = view(spark, sf, "events").selectExpr("event_id AS input_id", "CASE event_id % 3 WHEN 0 THEN 'whole_image' WHEN 1 THEN 'subject_isolated' ELSE 'other' END AS role", "event_id % 60 AS sha")
    return R.lookup_recorded(inp, rec)
