"""An archive of outputs in buckets is joined where it lies."""

import re

from pyspark.sql import functions as F

from photoflow.operators import planning as L
from photoflow.sources.shared import written


def test_the_archive_is_not_shuffled(spark, tmp_path):
    there = spark.range(0, 5000, 3).select(F.concat(F.lit("p/"), F.col("id"), F.lit(".json")).alias("sidecar_path"))
    there = there.union(there).union(spark.createDataFrame([(None,)], "sidecar_path string"))
    archive = L.archive_outputs(there, "archive_test", 6, location=str(tmp_path / "archive"))
    plan = spark.range(5000).select("id", F.concat(F.lit("p/"), F.col("id"), F.lit(".json")).alias("sidecar_path")).union(spark.createDataFrame([(-1, None)], "id long, sidecar_path string"))
    plan = written(plan, "plan")
    assert archive.count() == 1667
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (L.pending_work(plan, archive), L.with_existing(plan, archive)):
            text = df._jdf.queryExecution().executedPlan().toString()
            assert len(re.findall(r"Exchange hashpartitioning", text)) == 1 and "SortMergeJoin" in text
            assert "Exchange" not in text[text.index("FileScan") :] and "SelectedBucketsCount: 6 out of 6" in text
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sorted(r.id for r in L.pending_work(plan, archive).collect()) == [-1] + [k for k in range(5000) if k % 3]
    plain = L.apply_existing(plan, there, "fail")
    assert sorted(map(str, L.apply_existing(plan, archive, "fail").select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    spark.sql("DROP TABLE archive_test")
