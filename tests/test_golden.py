"""Hand-written cases of single operators, and properties that hold across runs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from photoflow.functions import geometry as G
from photoflow.functions import identity as I
from photoflow.functions import json_schema as J
from photoflow.functions import paths as P
from photoflow.operators import cache as C
from photoflow.operators import isolation as S
from photoflow.operators import keywords as K
from photoflow.operators import planning as L
from photoflow.operators import reports as A
from photoflow.operators import runs as R
from photoflow.operators import vocabulary as V
from photoflow.sources import documents as D
from photoflow.sources.inventory import scan_inventory

INSTANCE = "image_id int, idx int, area_pixels long, x double, y double, w double, h double, cx double, cy double"


@pytest.fixture
def tree(tmp_path):
    for name in ("_DSC0001.NEF", "b.jpg", ".hidden/x.jpg", "._x.jpg", "x.ai.json", "x.XMP", "x.mp4", ".DS_Store", "sub/_DSC0001.JPG", "sub/deep/c.Heic"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(name.encode() * 3)
    return tmp_path


def test_scan_finds_camera_names_and_prunes(spark, tree):
    flat = scan_inventory(spark, str(tree))[0]
    deep, errors = scan_inventory(spark, str(tree), recursive=True)
    assert sorted(r.relative_path for r in flat.collect()) == ["_DSC0001.NEF", "b.jpg", "x.mp4"]
    assert sorted(r.relative_path for r in deep.collect()) == ["_DSC0001.NEF", "b.jpg", "sub/_DSC0001.JPG", "sub/deep/c.Heic", "x.mp4"]
    assert errors.count() == 0
    one = scan_inventory(spark, str(tree / "sub/_DSC0001.JPG"))[0].first()
    assert (one.relative_path, one.file_extension, one.file_size) == ("_DSC0001.JPG", "JPG", 48)
    with pytest.raises(FileNotFoundError):
        scan_inventory(spark, str(tree / "none"))
    ok, bad = L.split_supported(deep)
    assert ok.count() == 4 and [r.error.code for r in bad.collect()] == ["E_UNSUPPORTED_FORMAT"]


def test_file_identity_follows_content_and_time(spark, tree):
    import hashlib

    files = scan_inventory(spark, str(tree))[0]
    full = {r.relative_path: r.identity for r in I.file_identity(files).collect()}
    assert full["b.jpg"].sha256 == hashlib.sha256((tree / "b.jpg").read_bytes()).hexdigest() and full["b.jpg"].policy == "sha256"
    fast = {r.relative_path: r.identity.sha256 for r in I.file_identity(files, "fast").collect()}
    os.utime(tree / "b.jpg", (1, 1))
    again = {r.relative_path: r.identity.sha256 for r in I.file_identity(scan_inventory(spark, str(tree))[0], "fast").collect()}
    assert again["b.jpg"] != fast["b.jpg"] and again["x.mp4"] == fast["x.mp4"]
    gone = I.file_identity(spark.createDataFrame(files.collect(), files.schema))
    os.remove(tree / "x.mp4")
    rows = {r.relative_path: r for r in gone.collect()}
    assert rows["x.mp4"].identity is None and rows["x.mp4"].error.recoverable and rows["b.jpg"].error is None


def test_paths(spark):
    df = spark.createDataFrame([("a/B.JPG", "/r/a/B.JPG"), ("c", "/q/c"), ("x/.y/z.nef", "/r/x/.y/z.nef"), ("q._x.jpg", "/r/q._x.jpg")], "p string, f string")
    got = df.select(P.stem(F.col("p")), P.extension(F.col("p")), P.folder(F.col("p")), P.is_ignored(F.col("p")), P.relative_path(F.col("f"), "/r/"), P.document_path(F.col("p"), "/o")).collect()
    assert [tuple(r) for r in got] == [("B", "JPG", "a", False, "a/B.JPG", "/o/a/B.JPG.ai.json"), ("c", "", "", False, "c", "/o/c.ai.json"), ("z", "nef", "x/.y", True, "x/.y/z.nef", "/o/x/.y/z.nef.ai.json"), ("q._x", "jpg", "", False, "q._x.jpg", "/o/q._x.jpg.ai.json")]


def test_case_only_collision_fails_every_member(spark):
    df = spark.createDataFrame([("A.jpg",), ("a.JPG",), ("b.jpg",)], "relative_path string").withColumn("sidecar_path", P.document_path(F.col("relative_path")))
    entries, collisions = L.plan_outputs(df)
    assert [r.relative_path for r in entries.collect()] == ["b.jpg"]
    assert [(r.path, r.sources) for r in L.collision_groups(collisions).collect()] == [("A.jpg.ai.json", ["A.jpg", "a.JPG"])]
    assert entries.count() + collisions.count() == df.count()


def instances(spark, *rows):
    return spark.createDataFrame([(1, i, a, x, y, w, h, x + w / 2, y + h / 2) for i, a, x, y, w, h in rows], INSTANCE)


def test_instance_selection_and_merging(spark):
    pick = lambda df: S.merge_decision(df).first()
    assert pick(instances(spark, (1, 100, 0.1, 0.1, 0.1, 0.1), (2, 250, 0.6, 0.6, 0.1, 0.1))).selected_indices == [2]
    assert pick(instances(spark, (1, 100, 0.0, 0.0, 0.1, 0.1), (2, 100, 0.45, 0.45, 0.1, 0.1))).selected_indices == [2]
    merged = pick(instances(spark, (1, 10000, 0.10, 0.10, 0.50, 0.50), (2, 100, 0.56, 0.52, 0.04, 0.04)))
    assert merged.merged and merged.selected_indices == [1, 2]
    apart = pick(instances(spark, (1, 10000, 0.10, 0.10, 0.25, 0.25), (2, 1000, 0.75, 0.75, 0.10, 0.10)))
    assert not apart.merged and apart.selected_indices == [1]


def test_isolation_record(spark):
    cols = "image_id int, width int, height int, analysis_width int, analysis_height int, max_long_edge int, max_total_pixels int, matte_rgb array<int>"
    images = spark.createDataFrame([(1, 120, 80, 120, 80, 2048, 4194304, [1, 2]), (2, 10, 10, 5, 5, 2048, 4194304, [0, 0, 0])], cols)
    got = {r.image_id: r for r in S.isolate(images, instances(spark, (1, 750, 0.375, 0.25, 0.25, 0.3125)), margin=0.08).collect()}
    r = got[1]
    assert (r.margin_pixels, tuple(r.crop_box), tuple(r.final_size), r.ratio, r.upscaled) == (3, (42, 17, 36, 31), (36, 31), 1.0, False)
    assert r.matte_rgb == [128, 128, 128] and r.scale_x == 1.0
    assert (got[2].status, got[2].error_code, got[2].crop_box) == ("no_foreground", "E_SUBJECT_ISOLATION_NO_FOREGROUND", None)


def test_dimensions_and_orientation(spark):
    df = spark.range(1).select(
        G.fit_dimensions(F.lit(10016), F.lit(3291), F.lit(2048), F.lit(4194304)).alias("a"), G.fit_dimensions(F.lit(100), F.lit(50), F.lit(2048), F.lit(4194304)).alias("b"), G.fit_dimensions(F.lit(100), F.lit(50), F.lit(200), F.lit(1 << 30), upscale=True).alias("c"),
        G.fit_dimensions(F.lit(0), F.lit(5), F.lit(1), F.lit(1)).alias("d"), G.resolve_orientation(F.lit(6), F.lit(3), F.lit(2)).alias("e"), G.resolve_orientation(F.lit(9), F.lit(3), F.lit(2)).alias("f"), G.resolve_orientation(F.lit(None).cast("int"), F.lit(3), F.lit(2)).alias("g"),
    ).first()
    assert (tuple(df.a), tuple(df.b), tuple(df.c), df.d) == ((2048, 672), (100, 50), (200, 100), None)
    assert (df.e.width, df.e.height, df.f.error, df.g.orientation) == (2, 3, "E_ORIENTATION_UNRESOLVED", 1)


def test_strip_fence_and_invalid_json(spark):
    rows = ['```json\n{"a":1}\n```', "```{bad", ' {"a":1} ', '{"a": - term:}', "```\n[1]"]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select(J.strip_fence(F.col("t")).alias("s"), J.parse_response(F.col("t")).isNull().alias("bad")).collect()
    assert [(r.s, r.bad) for r in got] == [('{"a":1}', False), ("```{bad", True), ('{"a":1}', False), ('{"a": - term:}', True), ("[1]", False)]


def test_cache_eviction_and_probe(spark):
    e = spark.createDataFrame([(1, "older", 5, 100, "h"), (1, "newer", 5, 200, "h")], "cache_id int, file_name string, byte_count long, last_accessed_at long, sha256 string")
    assert {r.file_name: r.evict for r in C.lru_evict(e, 8).collect()} == {"older": True, "newer": False}
    assert {r.file_name: r.evict for r in C.lru_evict(e, 8, e.where("file_name = 'older'")).collect()} == {"older": False, "newer": True}
    assert not any(r.evict for r in C.lru_evict(e, 10).collect())
    files = spark.createDataFrame([(1, "older"), (1, "manifest.json"), (1, "0" * 64 + "-r-whole_image.jpg"), (1, "notes.txt")], "cache_id int, file_name string")
    assert C.purge_summary(C.purge_candidates(files, e)).first().removed == 3


def test_attempts_recover_and_transport_errors_win(spark):
    rows = [(1, 0, "invalid_json", "E_I", "a", None), (1, 1, "valid", None, "b", None), (2, 0, "invalid_json", "E_I", "c", None), (2, 1, None, None, None, "E_T"), (3, 0, None, None, None, "E_T"), (4, 0, "valid", None, "d", None)]
    df = spark.createDataFrame(rows, "run_id int, attempt_no int, status string, error_code string, response string, transport_error string")
    got = {r.run_id: (r.json_valid, r.response, r.error_code, r.attempts is None) for r in R.resolve_attempts(df).collect()}
    assert got == {1: (True, "b", None, False), 2: (False, "c", "E_T", False), 3: (False, None, "E_T", True), 4: (True, "d", None, True)}
    assert R.resolve_attempts(df, 0).where("run_id = 1").first().error_code == "E_I"


def test_batch_summary_and_median(spark):
    p = spark.createDataFrame([(1, 1, "written", None), (1, 2, "failed", "E_SIDECAR_EXISTS")], "batch_id int, position int, status string, error_code string")
    r = A.batch_summary(p, p, p.select("batch_id")).first()
    assert (r.total_images, r.written, r.failed, r.errors) == (2, 1, 1, ["E_SIDECAR_EXISTS", "E_INTERRUPTED"])
    assert spark.range(1, 5).agg(A.upper_median("id")).first()[0] == 3 and spark.range(0).agg(A.upper_median("id")).first()[0] is None


def test_documents_round_trip(spark, tmp_path):
    rows = [("a/x.ai.json", '{"k":1}'), ("b.ai.json", '{"k":2}')]
    df = spark.createDataFrame(rows, "sidecar_path string, json string")
    assert {r.outcome for r in D.write_documents(df, str(tmp_path)).collect()} == {"written"}
    assert {r.outcome for r in D.write_documents(df, str(tmp_path)).collect()} == {"skipped_existing"}
    assert {r.outcome for r in D.write_documents(df.withColumn("json", F.lit("{}")), str(tmp_path), "fail").collect()} == {"failed"}
    (tmp_path / "bad.ai.json").write_text("[1]")
    ok, bad = D.read_documents(spark, [str(tmp_path / "a"), str(tmp_path / "b.ai.json"), str(tmp_path / "bad.ai.json")])
    assert sorted(r.j for r in ok.select(D.canonical_json(F.col("doc")).alias("j")).collect()) == ['{"k":1}', '{"k":2}'] and bad.first().error_code == "E_SIDECAR_INVALID"
    assert not [f for f in os.listdir(tmp_path) if f.endswith(".tmp")]


def test_progress_log(spark, tmp_path):
    log = spark.createDataFrame([("s", "written", 5)], "source_path string, status string, duration_ms long")
    D.append_progress(log, str(tmp_path / "log"))
    D.append_progress(log, str(tmp_path / "log"))
    (tmp_path / "log" / "x.json").write_text("not json\n")
    got = D.read_progress(spark, str(tmp_path / "log")).cache()
    assert got.count() == 3 and got.where("_corrupt_record is not null").count() == 1 and got.where("status = 'written'").count() == 2



def test_vocabulary_document(spark, tmp_path):
    doc = {"schema_version": "image-vocabulary/1.0", "entries": [{"canonical_path": "A|B", "parent_path": "A", "flat_keyword": "Straße", "synonyms": ["Café"]}]}
    (tmp_path / "v.json").write_text(json.dumps(doc))
    v, digest = V.load_vocabulary(spark, str(tmp_path / "v.json"))
    r = v.first()
    assert (r.auto_apply_allowed, r.requires_review, len(digest)) == (True, False, 64)
    terms = spark.createDataFrame([("STRASSE",), ("  CAFÉ ",), ("cafe",)], "term string")
    assert [x.canonical_path for x in V.canonicalize(terms, v).orderBy("term").collect()] == ["A|B", "A|B", None]
    (tmp_path / "w.json").write_text(json.dumps({**doc, "schema_version": "image-vocabulary/2.0"}))
    with pytest.raises(ValueError):
        V.load_vocabulary(spark, str(tmp_path / "w.json"))


def test_keyword_rules(spark):
    df = spark.createDataFrame([("  a \n b ",), ("café",), (None,)], "t string")
    assert [r[0] for r in df.select(K.normalize_keyword(F.col("t"))).collect()] == ["a b", "café", None]
    assert [r[0] for r in spark.createDataFrame([("New York",), ("Turdus merula",), ("red bird",), ("Owl",)], "t string").select(K.is_specific(F.col("t"))).collect()] == [True, True, False, False]
