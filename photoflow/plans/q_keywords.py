"""Keyword, vocabulary, consensus and review queries (KEY, VOC, CNS, REV)."""

import json

from pyspark.sql import functions as F

from photoflow.operators import consensus as C
from photoflow.operators import keywords as K
from photoflow.operators import vocabulary as V
from photoflow.plans.fixtures import ctes, view
from photoflow.plans.q_files import images as image_files
from photoflow.plans.q_json import RESPONSES
from photoflow.plans.registry import ORACLE_SQL, query
from photoflow.sources.shared import dealt

_O = ctes("v_observations")
_FOLD = "trim(regexp_replace(lower(term), '\\s+', ' ', 'g'))"
_BAND = "CASE confidence WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"
_CAND = f"""{ctes("v_observations", "v_vocabulary")},
obs AS (SELECT o.*, v.canonical_path FROM (SELECT *, {_FOLD} AS k FROM v_observations) o LEFT JOIN (SELECT min(canonical_path) AS canonical_path, k FROM (SELECT canonical_path, lower(flat_keyword) AS k FROM v_vocabulary UNION ALL SELECT canonical_path, synonym FROM v_vocabulary) GROUP BY k) v ON v.k = o.k)"""
_STATS = f"""{_CAND},
el AS (SELECT session_id, count(DISTINCT image_id) AS eligible FROM obs GROUP BY 1),
kept AS (SELECT DISTINCT session_id, image_id, canonical_path, confidence, input_role FROM obs WHERE {_BAND} >= 1 AND canonical_path IS NOT NULL),
up AS (SELECT session_id, image_id, confidence, input_role, list_aggregate(string_split(canonical_path, '|')[1:i], 'string_agg', '|') AS canonical_path FROM kept, (VALUES (1), (2), (3)) n(i) WHERE i <= len(string_split(canonical_path, '|'))),
st AS (SELECT up.session_id, canonical_path, count(DISTINCT image_id) AS supporting_images, any_value(eligible) AS eligible_images, count(DISTINCT image_id)::DOUBLE / any_value(eligible) AS frequency, bool_or(input_role = 'whole_image') AS in_whole, bool_or(input_role = 'subject_isolated') AS in_subject FROM up JOIN el ON up.session_id = el.session_id GROUP BY 1, 2),
leaf AS (SELECT canonical_path FROM v_vocabulary WHERE canonical_path NOT IN (SELECT parent_path FROM v_vocabulary WHERE parent_path IS NOT NULL)),
x AS (SELECT session_id, s.canonical_path, frequency, CASE WHEN v.canonical_path IN (SELECT canonical_path FROM leaf) THEN parent_path END AS pk, exclusive_group AS gk FROM st s JOIN v_vocabulary v ON s.canonical_path = v.canonical_path),
cf AS (SELECT DISTINCT a.session_id, a.canonical_path, b.canonical_path AS other_path, b.frequency AS other_frequency FROM x a JOIN x b ON a.session_id = b.session_id AND a.canonical_path <> b.canonical_path AND (a.pk = b.pk OR a.gk = b.gk)),
pr AS (SELECT s.session_id, s.canonical_path, supporting_images, eligible_images, frequency, CASE WHEN frequency < 0.4 THEN 'below_threshold' WHEN requires_review THEN 'requires_review' WHEN NOT auto_apply_allowed THEN 'not_allowed'
 WHEN EXISTS (SELECT 1 FROM cf WHERE cf.session_id = s.session_id AND cf.canonical_path = s.canonical_path AND other_frequency >= 0.4) THEN 'conflict' ELSE 'consensus' END AS rule FROM st s JOIN v_vocabulary v ON s.canonical_path = v.canonical_path)"""


def vocab(spark, sf):
    return view(spark, sf, "v_vocabulary").withColumn("synonyms", F.array("synonym"))


def observations(spark, sf):
    """Terms with their entries, an image's in one task."""
    return dealt(V.canonicalize(view(spark, sf, "v_observations"), vocab(spark, sf), ascii_only=True), "observations", "session_id", "image_id")


_ITEMS = [(i, f, k, x) for i, (r, _) in enumerate(RESPONSES) for f in K.FIELDS for k, x in enumerate(r.get(f, [])) if isinstance(x, dict)]
_ROWS = ", ".join("(" + ", ".join([str(i), f"'{f}'", str(k), "'" + x["term"].replace("'", "''") + "'", f"'{x['confidence']}'", f"'{x['evidence']}'" if "evidence" in x else "NULL"]) + ")" for i, f, k, x in _ITEMS)


@query(f"SELECT doc_id AS image_id, 'whole_image' AS input_role, f AS field, p AS position, t AS term, c AS confidence, e AS evidence FROM documents JOIN (VALUES {_ROWS}) r(i, f, p, t, c, e) ON i = doc_id % {len(RESPONSES)}")
def key_extract(spark, sf):
    """KEY1."""
    cases = F.array(*[F.lit(json.dumps(r)) for r, _ in RESPONSES])
    runs = view(spark, sf, "documents").select(F.col("doc_id").alias("image_id"), F.lit("whole_image").alias("input_role"), F.parse_json(F.get(cases, (F.col("doc_id") % len(RESPONSES)).cast("int"))).alias("parsed"))
    return K.extract_candidates(runs).where("term is not null")


@query("SELECT doc_id, trim(regexp_replace(nfc_normalize('  é' || chr(9) || text || ' '), '\\s+', ' ', 'g')) AS keyword FROM documents")
def key_normalize(spark, sf):
    """KEY2."""
    return view(spark, sf, "documents").select("doc_id", K.normalize_keyword(F.expr("'  é' || chr(9) || text || ' '")).alias("keyword"))


@query("SELECT doc_id, trim(regexp_replace(nfc_normalize('  é' || chr(9) || text || ' '), '\\s+', ' ', 'g')) AS keyword FROM documents")
def key_normalize_whole(spark, sf):
    """KEY2, of whole texts."""
    return view(spark, sf, "documents").select("doc_id", K.normalize_keyword(F.expr("'  é' || chr(9) || text || ' '")).alias("keyword"))


_MIX = "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a|b' WHEN 2 THEN 'New York' ELSE 'owl' END"


@query(f"SELECT o_orderkey, term, CASE WHEN contains(term, '|') THEN 'contains_separator' ELSE 'ok' END AS reason FROM (SELECT o_orderkey, {_MIX} AS term FROM orders) WHERE term <> ''")
def key_screen(spark, sf):
    """KEY3."""
    view(spark, sf, "orders")
    ok, bad = K.screen_keywords(spark.sql(f"SELECT o_orderkey, {_MIX} AS term FROM orders"))
    return ok.withColumn("reason", F.lit("ok")).unionByName(bad)


@query(f"SELECT o_orderkey, term FROM (SELECT o_orderkey, {_MIX} AS term FROM orders) WHERE term <> 'New York'")
def key_specific(spark, sf):
    """KEY6."""
    view(spark, sf, "orders")
    return K.screen_specific(spark.sql(f"SELECT o_orderkey, {_MIX} AS term FROM orders"))


_FIELDS = "image_id, input_role, confidence, CASE WHEN image_id % 2 = 0 THEN 'scene_context' ELSE 'main_subjects' END AS field, 0 AS position, term"


@query(f"""{_O}, c AS (SELECT DISTINCT {_FIELDS.replace("term", _FOLD + " AS term")} FROM v_observations WHERE {_BAND} >= 1),
w AS (SELECT *, row_number() OVER (PARTITION BY image_id, term ORDER BY CASE WHEN input_role = CASE WHEN field = 'scene_context' THEN 'whole_image' ELSE 'subject_isolated' END THEN 0 ELSE 1 END) AS n FROM c)
SELECT image_id, term, input_role FROM w WHERE n = 1""")
def key_roles(spark, sf):
    """KEY4, KEY5."""
    c = dealt(view(spark, sf, "v_observations"), "candidates", "image_id").withColumn("term", K.fold(F.col("term"), ascii_only=True)).selectExpr(*_FIELDS.split(", ")).distinct()
    return K.prefer_role(K.filter_band(c, "medium")).select("image_id", "term", "input_role")


@query(f"""{ctes("v_inventory")}, f AS (SELECT relative_path, regexp_replace(relative_path, '/?[^/]*$', '') || '/' || lower(regexp_replace(regexp_extract(relative_path, '[^/]*$'), '\\.[^.]*$', '')) AS pair_key, lower(regexp_extract(relative_path, '\\.([^.]*)$', 1)) AS ext FROM v_inventory WHERE doc_id % 12 < 9 AND doc_id % 29 <> 0)
SELECT pair_key, count(*) AS n_files, bool_or(ext IN ('nef', 'cr3')) AS has_raw, bool_or(ext IN ('jpg', 'jpeg')) AS has_jpeg, min(relative_path) AS target_path FROM f GROUP BY 1 HAVING count(*) > 1""")
def key_pairs(spark, sf):
    """KEY7."""
    return K.group_pairs(image_files(spark, sf))


_PAIRC = "SELECT l_orderkey % 50 AS target_path, l_partkey AS source_path, l_linenumber % 2 = 0 AS is_raw, CASE WHEN l_suppkey % 2 = 0 THEN upper(l_returnflag || CAST(l_suppkey % 30 AS STRING)) ELSE lower(l_returnflag || CAST(l_suppkey % 30 AS STRING)) END AS term FROM lineitem"


@query(f"""WITH c AS ({_PAIRC}), a AS (SELECT 'union' AS scope, * FROM c UNION ALL SELECT 'raw-only', * FROM c WHERE is_raw UNION ALL SELECT 'jpeg-only', * FROM c WHERE NOT is_raw)
SELECT scope, target_path, lower(term) AS folded, arg_min(term, (source_path, term)) AS term, count(DISTINCT source_path) AS n_sources, min(source_path) AS first_source FROM a GROUP BY 1, 2, 3""")
def key_scopes(spark, sf):
    """KEY8."""
    view(spark, sf, "lineitem")
    c, out = spark.sql(_PAIRC), None
    for scope in ("union", "raw-only", "jpeg-only"):
        x = K.resolve_pairs(c, scope).groupBy(F.lit(scope).alias("scope"), "target_path", "folded", "term", "n_sources").agg(F.min("source_path").alias("first_source"))
        out = x if out is None else out.union(x)
    return out


_NEW = "SELECT DISTINCT l_orderkey % 500 AS target_path, CASE WHEN l_orderkey % 2 = 0 THEN 'K' ELSE 'k' END || CAST(l_suppkey % 20 AS STRING) AS term FROM lineitem WHERE l_linenumber <= 3"
_OLD = "SELECT DISTINCT l_orderkey % 500 AS target_path, 'k' || CAST(l_suppkey % 20 AS STRING) AS term FROM lineitem WHERE l_linenumber > 3"
_CHANGE = f"""WITH a AS (SELECT target_path, lower(term) AS folded, min(term) AS n FROM ({_NEW}) GROUP BY 1, 2), b AS (SELECT target_path, lower(term) AS folded, min(term) AS o FROM ({_OLD}) GROUP BY 1, 2),
p AS (SELECT coalesce(a.target_path, b.target_path) AS target_path, coalesce(a.folded, b.folded) AS folded, CASE WHEN o IS NULL THEN 'add' WHEN n IS NULL THEN 'keep' ELSE 'skip' END AS action, CASE WHEN o IS NOT NULL AND n IS NOT NULL THEN 'already_present' END AS reason FROM a FULL JOIN b ON a.target_path = b.target_path AND a.folded = b.folded)"""


def change(spark, sf):
    view(spark, sf, "lineitem")
    return K.change_plan(spark.sql(_NEW), spark.sql(_OLD)).drop("term")


@query(f"{_CHANGE} SELECT * FROM p")
def key_changes(spark, sf):
    """KEY9."""
    return change(spark, sf)


@query(f"{_CHANGE} SELECT target_path, action, reason, count(*) AS n, (grouping(target_path) * 4 + grouping(action) * 2 + grouping(reason))::BIGINT AS level FROM p GROUP BY GROUPING SETS ((target_path), (action, reason), ())")
def key_report(spark, sf):
    """KEY12."""
    return K.export_report(change(spark, sf))


@query(f"""WITH o AS ({_OLD}), n AS ({_NEW}), af AS (SELECT * FROM o WHERE target_path % 7 <> 0 UNION SELECT * FROM n WHERE target_path % 11 <> 0),
d AS (SELECT 'lost' AS kind, * FROM (SELECT * FROM o EXCEPT SELECT * FROM af) UNION ALL SELECT 'missing', * FROM (SELECT * FROM n EXCEPT SELECT * FROM af)), f AS (SELECT DISTINCT target_path FROM o)
SELECT f.target_path, count(d.kind) AS n_differences, CASE WHEN count(d.kind) = 0 THEN 'ok' ELSE 'restore' END AS outcome FROM f LEFT JOIN d ON f.target_path = d.target_path GROUP BY 1""")
def key_roundtrip(spark, sf):
    """KEY10, KEY11."""
    view(spark, sf, "lineitem")
    old, new = spark.sql(_OLD), spark.sql(_NEW)
    after = old.where("target_path % 7 <> 0").union(new.where("target_path % 11 <> 0")).distinct()
    return K.validate_export(old, K.roundtrip_diff(old, after, new))


_BAD = "SELECT p_partkey AS id, 'Root|' || CAST(p_partkey % 700 AS STRING) AS canonical_path, CASE WHEN p_partkey % 97 = 0 THEN 'Gone' WHEN p_partkey % 50 < 2 THEN 'Root|' || CAST((p_partkey + 1 - p_partkey % 50 % 2 * 2) % 700 AS STRING) END AS parent_path, 'T' || CAST(p_partkey % 900 AS STRING) AS flat_keyword, 't' || CAST(p_partkey % 300 AS STRING) AS synonym FROM part"


@query(f"""WITH v AS ({_BAD}), r AS (SELECT canonical_path FROM v GROUP BY 1 HAVING count(*) > 1),
o AS (SELECT DISTINCT canonical_path FROM v WHERE parent_path IS NOT NULL AND parent_path NOT IN (SELECT canonical_path FROM v)),
nm AS (SELECT canonical_path, lower(flat_keyword) AS name, 0 AS s FROM v UNION ALL SELECT canonical_path, synonym, 1 FROM v), a AS (SELECT name FROM nm GROUP BY 1 HAVING count(DISTINCT canonical_path) > 1 AND max(s) = 1)
SELECT 'duplicate' AS kind, canonical_path AS name FROM r UNION ALL SELECT 'orphan', canonical_path FROM o UNION ALL SELECT 'ambiguous', name FROM a""")
def voc_violations(spark, sf):
    """VOC2, VOC3, VOC4."""
    return violations(spark, sf, _BAD)


def violations(spark, sf, bad):
    view(spark, sf, "part")
    v = spark.sql(bad).withColumn("synonyms", F.array("synonym"))
    named = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("name")).distinct()
    return named(V.duplicate_paths(v), "duplicate", "canonical_path").union(named(V.orphan_parents(v), "orphan", "canonical_path")).union(named(V.ambiguous_synonyms(v, ascii_only=True), "ambiguous", "name"))


@query(ORACLE_SQL["voc_violations"])
def voc_violations_whole(spark, sf):
    """As :func:`voc_violations`, which once read a part of the table."""
    return violations(spark, sf, _BAD)


_LOOPS = "SELECT CAST(p_partkey AS STRING) AS canonical_path, CASE WHEN p_partkey % 10 = 0 THEN CAST(p_partkey + 1 AS STRING) WHEN p_partkey % 10 = 1 THEN CAST(p_partkey - 1 AS STRING) WHEN p_partkey % 10 < 5 THEN CAST(p_partkey - 1 AS STRING) END AS parent_path FROM part"


@query("SELECT CAST(p_partkey AS VARCHAR) AS canonical_path FROM part p WHERE (p_partkey % 10 = 0 AND EXISTS (SELECT 1 FROM part q WHERE q.p_partkey = p.p_partkey + 1)) OR (p_partkey % 10 = 1 AND EXISTS (SELECT 1 FROM part q WHERE q.p_partkey = p.p_partkey - 1))")
def voc_cycles(spark, sf):
    """VOC5."""
    view(spark, sf, "part")
    return V.cycles(spark.sql(_LOOPS))


@query(f"{_CAND} SELECT session_id, image_id, canonical_path, count(*) AS n FROM obs GROUP BY 1, 2, 3")
def voc_canonical(spark, sf):
    """VOC6, VOC7."""
    return observations(spark, sf).groupBy("session_id", "image_id", "canonical_path").agg(F.count("*").alias("n"))


def stats(spark, sf):
    return C.consensus_stats(observations(spark, sf), "medium")


@query(f"{_STATS} SELECT session_id, canonical_path, supporting_images, eligible_images, frequency, in_whole, in_subject FROM st")
def cns_stats(spark, sf):
    """CNS1, CNS2, CNS3."""
    return stats(spark, sf).select("session_id", "canonical_path", "supporting_images", "eligible_images", "frequency", "in_whole", "in_subject")


@query(f"{_STATS} SELECT session_id, canonical_path, other_path FROM cf")
def cns_conflicts(spark, sf):
    """CNS4."""
    return C.conflicts(stats(spark, sf), vocab(spark, sf)).select("session_id", "canonical_path", "other_path")


@query(f"{_STATS} SELECT session_id, canonical_path, supporting_images, eligible_images, frequency, CASE WHEN rule = 'consensus' THEN 'propagate' ELSE 'hold' END AS decision, rule FROM pr")
def cns_propagate(spark, sf):
    """CNS5, CNS6, at a threshold of 0.4."""
    return C.propagate(stats(spark, sf), vocab(spark, sf), 0.4)


@query(f"""{_STATS}, own AS (SELECT DISTINCT session_id, image_id, canonical_path FROM obs WHERE canonical_path IS NOT NULL), im AS (SELECT DISTINCT session_id, image_id FROM obs),
sp AS (SELECT im.session_id, image_id, pr.canonical_path FROM im JOIN pr ON im.session_id = pr.session_id WHERE rule = 'consensus' EXCEPT SELECT * FROM own)
SELECT session_id, canonical_path, rule, count(*) AS images FROM (SELECT *, 'own_observation' AS rule FROM own UNION ALL SELECT *, 'batch_consensus' FROM sp) GROUP BY 1, 2, 3""")
def cns_decisions(spark, sf):
    """CNS10, CNS11."""
    o = observations(spark, sf)
    d = C.decisions(o, C.propagate(C.consensus_stats(o), vocab(spark, sf), 0.4), o)
    return d.groupBy("session_id", "canonical_path", "rule").agg(F.count("*").alias("images"))


@query(f"""{_CAND}, s AS (SELECT session_id, min(canonical_path) AS canonical_path FROM obs GROUP BY 1), cfl AS (SELECT DISTINCT session_id, image_id FROM obs WHERE image_id % 9 = 0)
SELECT i.session_id, i.image_id, s.canonical_path, NOT EXISTS (SELECT 1 FROM obs o WHERE o.session_id = i.session_id AND o.image_id = i.image_id AND o.canonical_path = s.canonical_path) AS weak
FROM (SELECT DISTINCT session_id, image_id FROM obs WHERE image_id % 9 <> 0) i JOIN s ON s.session_id = i.session_id""")
def cns_subject(spark, sf):
    """CNS7."""
    o = observations(spark, sf)
    s = o.groupBy("session_id").agg(F.min("canonical_path").alias("canonical_path"))
    return C.apply_session_subject(s, o, o.where("image_id % 9 = 0"), o.where("canonical_path is not null"))


@query(f"{ctes('v_vocabulary')}, s AS (SELECT DISTINCT c_mktsegment AS session_id, 'EUROPE' AS subject FROM customer UNION SELECT DISTINCT c_mktsegment, 'nowhere' FROM customer) SELECT session_id, subject, canonical_path, CASE WHEN canonical_path IS NULL THEN 'rejected' ELSE 'known' END AS outcome FROM s LEFT JOIN v_vocabulary ON lower(flat_keyword) = lower(subject)")
def cns_unknown_subject(spark, sf):
    """CNS8."""
    c = view(spark, sf, "customer").select(F.col("c_mktsegment").alias("session_id")).distinct()
    s = c.withColumn("subject", F.explode(F.array(F.lit("EUROPE"), F.lit("nowhere"))))
    return C.resolve_subject(s, vocab(spark, sf).select(F.col("flat_keyword").alias("term"), "canonical_path"))


_TREE = "SELECT DISTINCT l_orderkey AS image_id, CASE l_linenumber % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'A|B' ELSE 'A|B|' || CAST(l_suppkey % 3 AS STRING) END AS canonical_path FROM lineitem"


@query(f"WITH k AS ({_TREE}) SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.image_id = k.image_id AND starts_with(o.canonical_path, k.canonical_path || '|'))")
def cns_flat(spark, sf):
    """CNS9."""
    view(spark, sf, "lineitem")
    return C.flat_export(spark.sql(_TREE))


@query("SELECT doc_id, CASE WHEN doc_id % 4 IN (1, 2) OR doc_id % 10 = 0 THEN 'E_SESSION_STALE' END AS error_code FROM documents")
def cns_stale(spark, sf):
    """CNS12: another hash, another policy, and an asset that is gone."""
    d = view(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("relative_path"))
    ident = lambda p, s: F.struct(p.alias("policy"), s.alias("sha256")).alias("identity")
    now = d.where("doc_id % 10 <> 0").select("relative_path", ident(F.when(F.col("doc_id") % 4 == 2, "fast-us").otherwise("sha256"), F.when(F.col("doc_id") % 4 == 1, "x").otherwise("y")))
    return C.check_stale(d.select("doc_id", "relative_path", ident(F.lit("sha256"), F.lit("y"))), now).select("doc_id", "error_code")


@query(f"{ctes('v_progress')} SELECT source_path, arg_max(status, (ts, event_id)) AS status FROM v_progress GROUP BY 1 HAVING arg_max(coalesce(error_code, ''), (ts, event_id)) = 'E_DECODE_FAILED'")
def rev_state(spark, sf):
    """REV1."""
    return C.asset_state(view(spark, sf, "v_progress"), "E_DECODE_FAILED").select("source_path", "status")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN 'model' ELSE '' END || CASE WHEN o_orderkey % 3 <> 0 AND o_custkey % 2 = 0 THEN ',' ELSE '' END || CASE WHEN o_custkey % 2 = 0 THEN 'prompt' ELSE '' END AS stale FROM orders WHERE o_orderkey % 3 <> 0 OR o_custkey % 2 = 0")
def rev_reprocess(spark, sf):
    """REV2."""
    d = view(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "m2").when(F.col("o_orderkey") % 3 == 1, "m1").alias("model"), F.when(F.col("o_custkey") % 2 == 0, "p1").otherwise("p2").alias("prompt"))
    return C.needs_reprocess(d, {"model": "m2", "prompt": "p2"}).select("o_orderkey", F.array_join("stale", ",").alias("stale"))


_TAGS = "SELECT DISTINCT l_orderkey AS image_id, l_returnflag AS term FROM lineitem"


@query(f"WITH t AS ({_TAGS}) SELECT DISTINCT image_id, CASE WHEN term = 'R' AND image_id % 2 = 0 THEN 'N' ELSE term END AS term FROM t")
def rev_correct(spark, sf):
    """REV3."""
    view(spark, sf, "lineitem")
    t = spark.sql(_TAGS)
    return C.apply_correction(t, t.where("image_id % 2 = 0"), "R", "N")


_MERGE = "SELECT DISTINCT l_orderkey AS file_id, l_suppkey % 8 AS term FROM lineitem WHERE l_linenumber % 3 <> {}"


@query(f"""WITH s AS ({_MERGE.format(0)}), c AS ({_MERGE.format(1)}), a AS ({_MERGE.format(2)}), k AS (SELECT * FROM s UNION SELECT * FROM c UNION SELECT * FROM a),
f AS (SELECT k.*, EXISTS (SELECT 1 FROM s WHERE s.file_id = k.file_id AND s.term = k.term) AS s, EXISTS (SELECT 1 FROM c WHERE c.file_id = k.file_id AND c.term = k.term) AS c, EXISTS (SELECT 1 FROM a WHERE a.file_id = k.file_id AND a.term = k.term) AS a FROM k)
SELECT file_id, term, CASE WHEN c AND NOT s THEN 'added_outside' WHEN s AND NOT c THEN 'deleted_outside' WHEN a AND NOT s THEN 'approved' WHEN s AND NOT a THEN 'removed' ELSE 'unchanged' END AS why, (c AND NOT s) OR (NOT s AND a AND NOT c) OR (s AND c AND a) AS keep FROM f""")
def rev_remerge(spark, sf):
    """REV4."""
    view(spark, sf, "lineitem")
    return C.remerge(*[spark.sql(_MERGE.format(k)) for k in (0, 1, 2)])
