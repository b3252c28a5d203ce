"""Documents in parts: their texts in order are JSON, whatever the keys, ties and sizes."""

import json
import os

from pyspark.sql import functions as F

from photoflow.plans.fixtures import view
from photoflow.sources import documents as D
from photoflow.sources.parts import document_text, read_headers, read_items, write_parts


def test_documents_are_json(spark, tmp_path):
    path = str(tmp_path / "out")
    heads = spark.createDataFrame([("a", 1, 'x"y'), ("b/ c", 2, None), ("empty", 3, "z"), (None, 4, "w")], "k string, n int, title string")
    rows = [("a", 2, "two"), ("a", 1, "one"), ("a", 2, "two"), ("a", None, None), ("b/ c", 5, "é\n,]"), ("nobody", 1, "x"), (None, 1, "x")]
    items = spark.createDataFrame(rows, "k string, place int, what string").repartition(3)
    write_parts(heads, items, f"file://{path}", "k", ["place"], "items", F.struct("place", "what"))
    docs = {f: json.loads("".join(document_text(path, f))) for f in os.listdir(f"{path}/header") if "=" in f}
    assert sorted(docs.values(), key=lambda d: d["n"]) == [
        {"k": "a", "n": 1, "title": 'x"y', "items": [{"place": None, "what": None}, {"place": 1, "what": "one"}, {"place": 2, "what": "two"}, {"place": 2, "what": "two"}]},
        {"k": "b/ c", "n": 2, "title": None, "items": [{"place": 5, "what": "é\n,]"}]}, {"k": "empty", "n": 3, "title": "z", "items": []},
    ]
    assert sorted((r.k, r.n, r.title) for r in read_headers(spark, f"file://{path}", "k string, n int, title string").collect()) == [("a", 1, 'x"y'), ("b/ c", 2, None), ("empty", 3, "z")]
    got = read_items(spark, f"file://{path}", "place int, what string", "k").select("k", "item.*").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(r) for r in rows if r[0] not in (None, "nobody"))


def test_a_run_of_a_million_records_is_in_order(spark, tmp_path):
    path = str(tmp_path / "out")
    outputs = spark.range(1_000_000).select(F.lit("r").alias("run_id"), F.lpad(F.col("id") * 7919 % 1_000_003, 7, "0").alias("relative_path"), F.lit("exported").alias("status"), F.lit("whole_image").alias("role"), F.lit("o").alias("output"), F.lit("copy").alias("action"))
    outputs = outputs.union(outputs.limit(5).withColumn("role", F.lit("subject_isolated")))
    D.write_export_manifests(outputs, f"file://{path}")
    parts = sorted(os.listdir(f"{path}/items/run_id=r"))
    assert len([p for p in parts if p.startswith("part-")]) >= 2
    doc = json.loads("".join(document_text(path, "run_id=r")))
    places = [r["relative_path"] for r in doc["records"]]
    assert doc["total"] == doc["exported"] == len(places) == 1_000_000 and places == sorted(places) and sum(len(r["outputs"]) for r in doc["records"]) == 1_000_005


def test_summaries(spark, sf, tmp_path):
    log = view(spark, sf, "v_progress").withColumn("position", F.col("event_id"))
    D.write_batch_summaries(log.select("batch_id"), log, log.where("batch_id % 2 = 0").select("batch_id"), f"file://{tmp_path}/s")
    want = {r.batch_id: r for r in D.batch_counts(log.select("batch_id"), log).collect()}
    for folder in os.listdir(tmp_path / "s/header"):
        if "=" in folder:
            doc = json.loads("".join(document_text(f"{tmp_path}/s", folder)))
            own = sorted((r.position, r.error_code) for r in log.where(f"batch_id = {doc['batch_id']} and error_code is not null").collect())
            assert [(e["position"], e["code"]) for e in doc["errors"]] == own + [(None, "E_INTERRUPTED")] * (doc["batch_id"] % 2 == 0)
            assert doc["failed"] == want.pop(doc["batch_id"]).failed and doc["interrupted"] == (doc["batch_id"] % 2 == 0)
    assert not want
