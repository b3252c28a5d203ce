"""Streams over a log give what the batch forms give, over triggers, restarts, replays and failures."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from photoflow.plans.fixtures import view
from photoflow.plans.q_streams import rocksdb
from photoflow.streaming import progress as S
from photoflow.streaming.run import Arrivals, days_apart, run_available


def log(spark, sf):
    return view(spark, sf, "v_progress").withColumn("ts", F.col("ts").cast("timestamp"))


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_summary_and_windows(spark, sf):
    batch = log(spark, sf)
    assert rows(run_available(batch, S.summary, "complete")) == rows(S.summary(batch))
    assert rows(run_available(batch, S.throughput, "complete")) == rows(S.throughput(batch))


def test_windows_close_behind_the_watermark(spark, sf):
    a = Arrivals(log(spark, sf), days_apart("ts", 5, "2024-01-01"))
    a.run(lambda s: S.throughput(s).writeStream.format("parquet").option("path", f"{a.base}/out"))
    last = log(spark, sf).agg(F.max("ts")).first()[0]
    want = S.throughput(log(spark, sf)).where(F.expr("window_start + INTERVAL 1 HOUR") <= F.expr(f"TIMESTAMP '{last}' - INTERVAL 2 HOURS"))
    got = spark.read.schema(want.schema).parquet(f"file://{a.base}/out")
    assert rows(got) == rows(want) and got.count() > 100


def test_a_replayed_batch_changes_nothing(spark, sf):
    a = Arrivals(log(spark, sf), days_apart("ts", 3, "2024-01-01"))
    target = f"file://{a.base}/summary"
    write = lambda s: S.upserted(S.summary(s), target, ["batch_id"], every=4)
    a.run(write, stops=3)
    like = S.summary(log(spark, sf))
    assert rows(S.latest_rows(spark, target, ["batch_id"], like)) == rows(like)
    folders = len(glob.glob(f"{a.base}/summary/batch=*"))
    last = max(int(n) for n in os.listdir(f"{a.base}/checkpoint/commits") if n.isdigit())
    assert last >= 9 and folders <= 8  # earlier folders went
    for name in (str(last), f".{last}.crc"):
        os.remove(f"{a.base}/checkpoint/commits/{name}")  # as if the query had died before it could say that the batch is done
    a.run(write, stops=1)
    assert rows(S.latest_rows(spark, target, ["batch_id"], like)) == rows(like)
    assert rows(S.latest_rows(spark, f"file://{a.base}/none", ["batch_id"], like)) == []


def test_a_killed_log_sink_resumes(spark, tmp_path):
    df = spark.range(60).select(F.col("id").alias("event_id"), (F.col("id") / 10).cast("int").alias("part"))
    a = Arrivals(df, F.col("part"))
    flag, out = str(tmp_path / "dies"), f"file://{a.base}/out"
    open(flag, "w").close()

    def dies(batches):
        for b in batches:
            yield b
            if os.path.exists(flag) and (b["event_id"] == 35).any():
                os.remove(flag)
                raise RuntimeError("killed")

    write = lambda s: S.appended(s.mapInPandas(dies, df.schema), out)
    with pytest.raises(Exception, match="killed"):
        a.run(write, stops=1)
    part = spark.read.schema(df.schema).json(out)
    assert part.count() == part.distinct().count() < 60
    a.run(write, stops=1)
    assert rows(spark.read.schema(df.schema).json(out)) == rows(df)


def test_repeats_within_and_beyond_the_delay(spark):
    at = lambda day, hour: f"2024-01-{day:02d} {hour:02d}:00:00"
    data = [(0, "a", at(1, 1)), (0, "a", at(1, 9)), (0, "b", at(1, 23)), (1, "b", at(2, 5)), (1, "c", at(2, 5)), (2, "a", at(4, 0)), (2, "c", at(2, 5)), (3, "z", at(9, 0)), (4, "a", at(12, 0)), (4, "a", at(5, 0))]
    df = spark.createDataFrame(data, "part int, source_path string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("batch_id", F.lit(1))
    a = Arrivals(df, F.col("part"))
    out = f"file://{a.base}/out"
    a.run(lambda s: S.appended(S.deduplicated(s, "12 hours").select("part", "source_path"), out), stops=5)
    # b's repeat is within the delay; c's came late; a is a row again once its state is gone, and late rows are never one
    assert rows(spark.read.schema("part int, source_path string").json(out)) == rows(spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (2, "a"), (3, "z"), (4, "a")], "part int, source_path string"))


@pytest.mark.parametrize("idle", [None, "2 days"])
def test_asset_state_over_triggers_and_restarts(spark, idle):
    """Assets get newer, older, equal and late events in later triggers; some go idle and come back."""
    at = lambda day, hour=0: f"2024-01-{day:02d} {hour:02d}:00:00"
    data = [
        (0, 1, "a", "written", at(1, 5)), (0, 2, "b", "failed", at(1, 6)), (0, 3, "c", "failed", at(1, 6)), (1, 4, "a", "failed", at(1, 3)), (1, 5, "b", "written", at(2)), (1, 0, "c", "written", at(1, 6)),
        (2, 6, "d", "written", at(6)), (3, 7, "b", "failed", at(9)), (3, 8, "e", "written", at(10)), (4, 9, "e", "failed", at(9, 12)), (4, 10, "a", "late", at(1, 7)), (5, 11, "f", "written", at(12)),
    ]
    df = spark.createDataFrame(data, "part int, event_id long, source_path string, status string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    a = Arrivals(df, F.col("part"))

    def save(batch, number):
        batch.write.mode("overwrite").parquet(f"file://{a.base}/out/batch={number}")

    with rocksdb(spark):
        a.run(lambda s: S.stream_asset_state(s, idle, "1 day").writeStream.foreachBatch(save).outputMode("update"), stops=6)
    out = spark.read.schema("source_path string, status string, ts timestamp, event_id long" + ", idle boolean" * bool(idle)).parquet(f"file://{a.base}/out").drop("batch")
    kept = df.where("status <> 'late'") if idle else df
    assert rows(S.latest_updates(out)) == rows(S.latest_state(kept, idle))
    if idle:
        b = [tuple(r)[:2] for r in out.where("source_path = 'b'").orderBy("ts", "idle").select("idle", "status").collect()]
        assert b == [(False, "failed"), (False, "written"), (True, "written"), (False, "failed"), (True, "failed")]
