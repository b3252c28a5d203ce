"""Observations are dealt by image to tasks of a bounded number of rows."""

import pytest
from pyspark.sql import functions as F

from photoflow.plans import q_keywords as Q
from photoflow.sources import shared


def tasks(df, *keys):
    return df.groupBy(*keys, F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"))


def test_observations_are_dealt_by_image(spark, sf, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 200)
    o = Q.observations(spark, sf)
    n, each = o.count(), [r.n for r in tasks(o).collect()]
    assert len(each) > n // 400 and max(each) < 600
    images = tasks(o, "session_id", "image_id").groupBy("session_id", "image_id").count()
    assert images.where("count > 1").isEmpty()


@pytest.mark.parametrize("rows", [0, 1, 5])
def test_few_rows_are_dealt_whole(spark, rows):
    assert sorted(r.id for r in shared.dealt(spark.range(rows), "few", "id").collect()) == list(range(rows))
