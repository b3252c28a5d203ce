"""Trees of documents are read in tasks, and written in as many tasks as there are cores to use."""

import os

from pyspark.sql import functions as F

from photoflow.sources import documents as D
from photoflow.sources import tree_sink as W


def test_documents_of_a_tree(spark, tmp_path):
    texts = {"a/1.ai.json": '{"n":1}', "a/b/2.ai.json": "[1]", "é #%.ai.json": '{"n":3}', "_4.ai.json": "", "5.json": "{}", ".staged/6.ai.json": "{}"}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "7.ai.json").write_bytes(b'{"n":"\xff"}')
    good, bad = D.read_document_tree(spark, str(tmp_path))
    name = lambda p: os.path.relpath(p, tmp_path)
    assert {name(r.path): r.n for r in good.select("path", D.get(F.col("doc"), "$.n", "int").alias("n")).collect()} == {"a/1.ai.json": 1, "é #%.ai.json": 3}
    assert {name(r.path): r.error_code for r in bad.collect()} == {f: "E_SIDECAR_INVALID" for f in ("a/b/2.ai.json", "_4.ai.json", "7.ai.json")}


def test_files_that_are_gone_have_a_problem(spark, tmp_path):
    (tmp_path / "1").write_text("x")
    got = {os.path.basename(r.path): (r.value, r.problem is not None) for r in D.read_texts(spark.createDataFrame([(f"{tmp_path}/{k}",) for k in (1, 2)], "path string")).collect()}
    assert got == {"1": ("x", False), "2": (None, True)}


def test_few_bytes_are_many_tasks(spark, tmp_path):
    df = spark.range(0, 400, 1, 1).select(F.concat("id", F.lit(".json")).alias("sidecar_path"), F.lit("{}").alias("json"))
    staged = W.stage(df, str(tmp_path))
    attempts = {os.path.dirname(r.staged) for r in staged.rows.collect()}
    assert len(attempts) > 1
    assert {r.outcome for r in W.publish(staged, "fail").collect()} == {"written"}
    W.clear(staged)
    assert sorted(os.listdir(tmp_path)) == sorted(f"{k}.json" for k in range(400))
