"""The progress log as a stream: tail, running summary, de-duplication, windows, the latest state per asset, and sinks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from photoflow.operators.reports import STATUSES

LOG = "event_id bigint, ts timestamp, batch_id int, source_path string, status string, error_code string, duration_ms bigint"


def stream_progress(spark: SparkSession, path: str, schema: str = LOG, files_per_trigger: int | None = None) -> DataFrame:
    """Tail a folder of JSONL files (STR1)."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def summary(df: DataFrame) -> DataFrame:
    """Counts per batch and status, of a stream (update or complete mode) or a table (STR2)."""
    return df.groupBy("batch_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def upserted(df: DataFrame, path: str, keys: list[str], every: int = 20) -> DataStreamWriter:
    """Write a stream of updates (rows that replace those of their ``keys``) to a keyed table in ``path`` (STR2).

    A micro-batch's rows are a folder with its number, which is written over when the batch runs again: a replay changes
    nothing. Each ``every``-th batch writes all keys' rows, and the folders before it go with the batch that follows, so
    that as many are left as two rounds have. :func:`latest_rows` reads the table.
    """

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        out = batch
        if number % every == every - 1:
            before = _folders(spark, path, lambda k: k < number)
            if before:
                out = latest(_numbered(spark, before, batch).unionByName(batch.withColumn("_batch", F.lit(number).cast("long"))), keys)
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")
        whole = number - (number + 1) % every
        if whole > 0 and whole < number:
            for old in _folders(spark, path, lambda k: k < whole).values():
                p = spark._jvm.org.apache.hadoop.fs.Path(old)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    return df.writeStream.foreachBatch(save).outputMode("update")


def _folders(spark: SparkSession, path: str, wanted) -> dict[int, str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [str(x.getPath().toString()) for x in fs.listStatus(p)] if fs.exists(p) else []
    return {k: n for n in names if "batch=" in n and wanted(k := int(n.rpartition("batch=")[2]))}


def _numbered(spark: SparkSession, folders: dict[int, str], like: DataFrame) -> DataFrame:
    """Rows of these micro-batches with their number."""
    rows = spark.read.schema(like.schema).parquet(*folders.values())
    return rows.withColumn("_batch", F.regexp_extract(F.col("_metadata.file_path"), "batch=([0-9]+)", 1).cast("long"))


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the last ``_batch`` for each of ``keys``."""
    rest = [c for c in rows.columns if c not in keys and c != "_batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def latest_rows(spark: SparkSession, path: str, keys: list[str], like: DataFrame) -> DataFrame:
    """The keyed table that :func:`upserted` writes, with the columns of ``like``."""
    folders = _folders(spark, path, lambda k: True)
    return latest(_numbered(spark, folders, like), keys) if folders else spark.createDataFrame([], like.schema)


def appended(df: DataFrame, path: str) -> DataStreamWriter:
    """Append a stream's rows to a log of JSONL files (SNK3); the sink's own list of committed files makes each row count once.

    A batch that ran before and was not committed leaves files that readers of ``path`` don't look at.
    """
    return df.writeStream.format("json").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").option("path", path).outputMode("append")


def deduplicated(df: DataFrame, delay: str = "1 day", keys: tuple[str, ...] = ("batch_id", "source_path")) -> DataFrame:
    """Each file of a batch once: the log is written at least once (STR3).

    A stream keeps a key until the watermark, which is ``delay`` behind the latest time, has passed the first row's time
    by ``delay``; a repeat after that is a row again, and one that is older than the watermark itself is dropped as late.
    """
    keys = list(keys)
    return df.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def throughput(df: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Files and milliseconds per window (STR4); a stream appends a window once the watermark has passed it."""
    df = df.withWatermark("ts", delay) if df.isStreaming else df
    g = df.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("files"), F.sum("duration_ms").alias("duration_ms"))
    return g.select(F.col("w.start").alias("window_start"), "files", "duration_ms")


def latest_state(df: DataFrame, idle: str | None = None, delay: str = "1 day") -> DataFrame:
    """Batch twin of :func:`stream_asset_state`: the status of the latest event of each asset, the greater id breaking ties.

    With ``idle``, a column says whether the asset's last event is that long before the watermark, ``delay`` behind the
    latest time of all.
    """
    key = F.struct("ts", "event_id")
    out = df.groupBy("source_path").agg(F.max_by("status", key).alias("status"), F.max("ts").alias("ts"), F.max_by("event_id", key).alias("event_id"))
    if idle is None:
        return out
    last = df.agg(F.max("ts").alias("_last"))  # one row
    return out.join(F.broadcast(last)).select("source_path", "status", "ts", "event_id", (F.col("ts") + F.expr(f"INTERVAL {idle}") <= F.col("_last") - F.expr(f"INTERVAL {delay}")).alias("idle"))


def _milliseconds(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000)


def stream_asset_state(df: DataFrame, idle: str | None = None, delay: str = "1 day") -> DataFrame:
    """Each asset's status by event time, kept in a ValueState (STR5); needs the RocksDB state store. Rows are updates.

    The state is what the checkpoint has, so later triggers and restarts go on from it. With ``idle`` (as ``5 days``) an
    event-time timer ends an asset's state once the watermark, ``delay`` behind the latest time, is that long past its
    last event: an update says so (``idle``), and the state is freed. Events older than the watermark are dropped.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    wait = _milliseconds(idle) if idle else None

    def row(key, best, is_idle: bool) -> pd.DataFrame:
        return pd.DataFrame({"source_path": [key[0]], "status": [best[2]], "ts": [pd.Timestamp(best[0])], "event_id": [best[1]], **({"idle": [is_idle]} if wait else {})})

    class Latest(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("latest", "ts timestamp, event_id bigint, status string")

        def handleInputRows(self, key, rows, timerValues):
            now = self.state.get() if self.state.exists() else None
            best = (pd.Timestamp(now[0]), now[1], now[2]) if now else None
            before = best
            for pdf in rows:
                top = pdf.sort_values(["ts", "event_id"]).iloc[-1]
                seen = (pd.Timestamp(top["ts"]), int(top["event_id"]), top["status"])
                if best is None or seen[:2] > best[:2]:
                    best = seen
            if best is before:
                return
            if wait:
                if before:
                    self.handle.deleteTimer(self._ends(before))
                self.handle.registerTimer(self._ends(best))
            self.state.update((best[0].to_pydatetime(), best[1], best[2]))
            yield row(key, best, False)

        @staticmethod
        def _ends(best) -> int:
            return best[0].value // 1_000_000 + wait

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if self.state.exists():
                best = self.state.get()
                self.state.clear()
                yield row(key, best, True)

        def close(self) -> None:
            pass

    columns = "source_path string, status string, ts timestamp, event_id bigint"
    df = df.withWatermark("ts", delay) if wait else df
    return df.groupBy("source_path").transformWithStateInPandas(Latest(), outputStructType=columns + (", idle boolean" if wait else ""), outputMode="Update", timeMode="EventTime" if wait else "None")


def latest_updates(updates: DataFrame) -> DataFrame:
    """Each asset's last update of :func:`stream_asset_state`; that it is idle comes after the event that it is idle since."""
    rest = [c for c in updates.columns if c != "source_path"]
    order = F.struct("ts", "event_id", "idle") if "idle" in rest else F.struct("ts", "event_id")
    return updates.groupBy("source_path").agg(F.max_by(F.struct(*rest), order).alias("_r")).select("source_path", *[f"_r.{c}" for c in rest])
