"""Streaming queries (STR, SNK3): a log derived from ``events`` that arrives in files, is streamed with stops between, and read back."""

import contextlib

from pyspark.sql import functions as F

from photoflow.plans.fixtures import ctes, view
from photoflow.plans.registry import query
from photoflow.streaming import progress as S
from photoflow.streaming.run import Arrivals, days_apart, run_available

_P = ctes("v_progress")
_FIRST = "2024-01-01"


def log(spark, sf):
    return view(spark, sf, "v_progress").withColumn("ts", F.col("ts").cast("timestamp"))


@contextlib.contextmanager
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@query(f"{_P} SELECT batch_id, count(*) AS total, count(CASE WHEN status = 'written' THEN 1 END) AS written, count(CASE WHEN status = 'skipped_existing' THEN 1 END) AS skipped_existing, count(CASE WHEN status = 'dry_run' THEN 1 END) AS dry_run, count(CASE WHEN status = 'failed' THEN 1 END) AS failed FROM v_progress GROUP BY 1")
def str_summary(spark, sf):
    """STR1, STR2: the running summary, upserted in update mode over several triggers and a restart."""
    rows = log(spark, sf)
    a = Arrivals(rows, days_apart("ts", 6, _FIRST))
    target = f"file://{a.base}/summary"
    a.run(lambda s: S.upserted(S.summary(s), target, ["batch_id"], every=3))
    return S.latest_rows(spark, target, ["batch_id"], S.summary(rows))


_REPEATS = f"""{_P}, c AS (SELECT event_id, batch_id, source_path, ts FROM v_progress UNION ALL SELECT event_id, batch_id, source_path, ts + INTERVAL 10 MINUTE FROM v_progress
    UNION ALL SELECT event_id, batch_id, source_path, ts + CASE WHEN event_id % 2 = 0 THEN INTERVAL 10 DAY ELSE INTERVAL 6 HOUR END FROM v_progress
    UNION ALL SELECT event_id, batch_id, source_path, ts FROM v_progress WHERE event_id % 10 = 7),
l AS (SELECT *, lag(ts) OVER (PARTITION BY event_id, batch_id, source_path ORDER BY ts) AS before FROM c)"""


@query(f"{_REPEATS} SELECT batch_id, source_path, count(*) AS files FROM l WHERE before IS NULL OR ts - before > INTERVAL 12 HOUR GROUP BY 1, 2")
def str_dedup(spark, sf):
    """STR3: rows are repeated after 10 minutes and 6 hours, within the delay, and after 10 days, beyond it; late repeats never count.

    Each trigger sees four days and the delay is 12 hours, so the state of a first row is gone when a repeat comes 10 days
    after it, and is there for the others. The repeats of equal time come 8 days late.
    """
    rows = log(spark, sf).select("event_id", "batch_id", "source_path", "ts")
    own = days_apart("ts", 4, _FIRST)
    again = rows.withColumn("ts", F.expr("ts + CASE WHEN event_id % 2 = 0 THEN INTERVAL 10 DAYS ELSE INTERVAL 6 HOURS END"))
    all_ = rows.union(rows.withColumn("ts", F.expr("ts + INTERVAL 10 MINUTES"))).union(again).withColumn("at", own)
    all_ = all_.union(rows.where("event_id % 10 = 7").withColumn("at", own + 2))
    a = Arrivals(all_, F.col("at"))
    out = f"file://{a.base}/out"
    keys = ("event_id", "batch_id", "source_path")
    a.run(lambda s: S.appended(S.deduplicated(s, "12 hours", keys).select("batch_id", "source_path"), out))
    return spark.read.schema("batch_id int, source_path string").json(out).groupBy("batch_id", "source_path").agg(F.count("*").alias("files"))


@query(f"{_P} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS files, sum(duration_ms)::BIGINT AS duration_ms FROM v_progress GROUP BY 1")
def str_throughput(spark, sf):
    """STR4, in complete mode, so that the last windows count too."""
    out = run_available(log(spark, sf), S.throughput, "complete")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "files", "duration_ms")


@query(f"{_P} SELECT source_path, arg_max(status, (ts, event_id)) AS status FROM v_progress GROUP BY 1")
def str_asset_state(spark, sf):
    """STR5 by its batch twin; :func:`str_asset_stream` is the stateful form."""
    return S.latest_state(log(spark, sf)).select("source_path", "status")


@query(f"""{_P}, k AS (SELECT * FROM v_progress WHERE NOT (event_id % 10 = 7 AND ts < TIMESTAMP '2024-01-13')), g AS (SELECT max(ts) AS last FROM k)
SELECT source_path, arg_max(status, (ts, event_id)) AS status, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) + INTERVAL 5 DAY <= any_value(last) - INTERVAL 1 DAY AS idle FROM k, g GROUP BY 1""")
def str_asset_stream(spark, sf):
    """STR5 as a stream: two files a trigger, a restart between, events out of order and late, and idle assets that expire.

    Of a file's last 12 hours one event of ten comes with the next file, within the watermark's delay; one of ten of the
    first 12 days comes with the last file, when the watermark is past it.
    """
    rows = log(spark, sf)
    block = days_apart("ts", 4, _FIRST)
    late = (F.col("event_id") % 10 == 7) & (F.col("ts") < F.lit("2024-01-13").cast("timestamp"))
    slow = (F.col("event_id") % 10 == 3) & (days_apart("ts", 4, "2023-12-31 12:00:00") > block)
    a = Arrivals(rows, F.when(late, 7).when(slow, F.least(block + 1, F.lit(7))).otherwise(block))
    out = f"{a.base}/updates"

    def save(batch, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"file://{out}/batch={number}")

    with rocksdb(spark):
        a.run(lambda s: S.stream_asset_state(s, "5 days", "1 day").writeStream.foreachBatch(save).outputMode("update"), files_per_trigger=2)
    updates = spark.read.schema("source_path string, status string, ts timestamp, event_id bigint, idle boolean").parquet(f"file://{out}").drop("batch")
    return S.latest_updates(updates).select("source_path", "status", "event_id", "idle")


@query(f"""{_P}, m AS (SELECT max(ts) AS last FROM v_progress)
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS files, sum(duration_ms)::BIGINT AS duration_ms FROM v_progress, m
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= last - INTERVAL 2 HOUR GROUP BY 1""")
def str_throughput_closed(spark, sf):
    """STR4, in append mode: windows come once the watermark has passed them."""
    out = run_available(log(spark, sf), S.throughput, "append")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "files", "duration_ms")


@query(f"{_P} SELECT source_path, status, count(*) AS n, sum(duration_ms)::BIGINT AS duration_ms, min(event_id) AS first_id, max(event_id) AS last_id FROM v_progress GROUP BY 1, 2")
def snk_progress_stream(spark, sf):
    """SNK3: a log that a stream appends to, over several triggers and a restart, read back as a stream of its own."""
    rows = log(spark, sf).select("event_id", "ts", "source_path", "status", "duration_ms")
    a = Arrivals(rows, days_apart("ts", 8, _FIRST))
    copy = f"file://{a.base}/copy"
    a.run(lambda s: S.appended(s, copy))
    out = f"file://{a.base}/read"
    read = spark.readStream.schema(rows.schema).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(copy)
    read.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{a.base}/read-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).groupBy("source_path", "status").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("duration_ms"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))
