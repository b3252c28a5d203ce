"""Files per row exactly once: tasks that run again, second actions, and every policy."""

import os
import subprocess
import sys
import textwrap
from pathlib import Path

import pytest

from photoflow.sources import tree_sink as W

SCHEMA = "sidecar_path string, json string"


def said(df):
    return sorted((r[0] or "", r.outcome, r.error_code) for r in df.collect())


def test_policies_and_second_actions(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = spark.createDataFrame([("a/1.json", "one"), ("a/2.json", "two"), ("b.json", "")], SCHEMA)
    out = W.write_documents(rows, root)
    assert said(out) == said(out) == [("a/1.json", "written", None), ("a/2.json", "written", None), ("b.json", "written", None)]
    assert (tmp_path / "t/a/1.json").read_text() == "one"
    out = W.write_documents(rows, root, "fail")  # equal text fails as well
    assert said(out) == said(out) == [(p, "failed", "E_SIDECAR_EXISTS") for p in ("a/1.json", "a/2.json", "b.json")]
    new = spark.createDataFrame([("a/1.json", "new"), ("c.json", "new")], SCHEMA)
    assert said(W.write_documents(new, root)) == [("a/1.json", "skipped_existing", None), ("c.json", "written", None)]
    assert (tmp_path / "t/a/1.json").read_text() == "one"
    out = W.write_documents(new, root, "overwrite")
    assert said(out) == said(out) == [("a/1.json", "written", None), ("c.json", "written", None)]
    assert (tmp_path / "t/a/1.json").read_text() == "new"
    assert sorted(os.listdir(root)) == ["a", "b.json", "c.json"]  # nothing staged is left
    with pytest.raises(ValueError, match="policy"):
        W.write_documents(new, root, "other")


def test_odd_rows(spark, tmp_path):
    root = str(tmp_path / "t")
    os.makedirs(f"{root}/dir.json")
    rows = [(None, "x"), ("", "x"), ("/abs.json", "x"), ("../out.json", "x"), ("a/../../t2/x.json", "x"), ("null.json", None), ("dir.json", "x"), ("ok/./é\r\n.json", "ü\r\n"), ("same.json", "x"), ("same.json", "x")]
    for policy, existing in (("skip", "skipped_existing"), ("fail", "failed"), ("overwrite", "failed")):
        got = said(W.write_documents(spark.createDataFrame([r for r in rows if policy == "skip" or r[0] in (None, "dir.json")], SCHEMA), root, policy))
        assert [x for x in got if x[0] == "dir.json"][0][1] == existing
        if policy == "skip":
            assert [x[1:] for x in got if x[0] in ("", "/abs.json", "../out.json", "a/../../t2/x.json", "null.json")] == [("failed", "E_WRITE_FAILED")] * 6
            assert sorted(x[1] for x in got if x[0] == "same.json") == ["skipped_existing", "written"]
    assert (tmp_path / "t/ok/é\r\n.json").read_bytes() == "ü\r\n".encode() and sorted(os.listdir(tmp_path)) == ["t"]
    assert said(W.write_documents(spark.createDataFrame([], SCHEMA), root)) == []


def test_publishing_twice_says_the_same(spark, tmp_path):
    root = str(tmp_path / "t")
    W.write_documents(spark.createDataFrame([(f"{k}.json", "old") for k in range(0, 60, 2)], SCHEMA), root)
    for policy in ("skip", "fail", "overwrite"):
        staged = W.stage(spark.createDataFrame([(f"{k}.json", f"{policy} {k}") for k in range(60)], SCHEMA).repartition(3), root)
        first = said(W.publish(staged, policy))
        assert said(W.publish(staged, policy)) == first
        W.clear(staged)
        texts = {p: (tmp_path / "t" / p).read_text() for p, *_ in first}
        assert all(texts[p].startswith(policy) == (o == "written") for p, o, _ in first)
        for k in range(1, 60, 2):
            os.remove(f"{root}/{k}.json")


def test_tasks_that_are_lost(tmp_path):
    """Each task dies once, halfway, in both jobs; Spark runs it again."""
    code = f"""
    import os, sys
    sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
    from pyspark import TaskContext
    from pyspark.sql import SparkSession
    from photoflow.sources import tree_sink as W
    spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.execution.arrow.maxRecordsPerBatch", "5").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    root = {str(tmp_path / "t")!r}
    rows = spark.createDataFrame([(f"d{{k % 3}}/{{k}}.json", str(k)) for k in range(40)], "sidecar_path string, json string").repartition(2)
    W.write_documents(rows.where("json % 4 = 0"), root)
    link, links = os.link, []
    def once(work):
        def run(*a):
            context = TaskContext.get()
            links.append(context.partitionId())
            if context.attemptNumber() == 0 and links.count(context.partitionId()) > 7:
                raise SystemExit("lost")
            return work(*a)
        return run
    linked = W._linked
    W._linked = once(linked)
    place = W._place
    W._place = once(place)
    import cloudpickle
    from pyspark import cloudpickle as own
    own.register_pickle_by_value(W)
    got = sorted((r.sidecar_path, r.outcome) for r in W.write_documents(rows, root, "fail").collect())
    assert got == sorted((f"d{{k % 3}}/{{k}}.json", "failed" if k % 4 == 0 else "written") for k in range(40)), got
    assert sum(len(names) for d, _, names in os.walk(root)) == 40 and sorted(os.listdir(root)) == ["d0", "d1", "d2"]
    tracker = spark.sparkContext.statusTracker()
    print("LOST", sum(s.numFailedTasks for j in tracker.getJobIdsForGroup(None) for s in map(tracker.getStageInfo, tracker.getJobInfo(j).stageIds) if s))
    """.replace("    import cloudpickle\n", "")
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-3000:]
    assert int(done.stdout.rsplit("LOST", 1)[1]) >= 2
