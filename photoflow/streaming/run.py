"""Run a stream over a table's rows until they are used up, for backfills and comparisons with batch."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from photoflow.sources.shared import mounted_dir, shared_dir

MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def run_available(rows: DataFrame, transform: Callable[[DataFrame], DataFrame], mode: str, files_per_trigger: int | None = None) -> DataFrame:
    """Write ``rows`` as a log in the shared folder, stream it through ``transform`` with availableNow, and read the outcome.

    In complete mode the last batch's rows are the outcome, in append mode all of them.
    """
    spark = rows.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows.write.option("timestampFormat", MICROS).json(f"{base}/log")
    reader = spark.readStream.schema(rows.schema).option("timestampFormat", MICROS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    out = transform(reader.json(f"{base}/log"))

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/last" if mode == "complete" else f"{base}/out/batch={number}")

    out.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out/last" if mode == "complete" else f"{base}/out").select(*out.columns)


class Arrivals:
    """Rows as the files of a log that arrive one after the other, a file for each value of ``delivery``, in its order."""

    def __init__(self, rows: DataFrame, delivery: Column):
        self.spark, self.schema = rows.sparkSession, rows.schema
        self.base = f"{mounted_dir(self.spark)}/arrivals-{uuid.uuid4().hex}"
        kept = rows.withColumn("_delivery", delivery.cast("int"))
        kept.repartition("_delivery").write.partitionBy("_delivery").option("timestampFormat", MICROS).json(f"file://{self.base}/kept")
        os.makedirs(f"{self.base}/log")
        self.waiting = sorted(int(n.partition("=")[2]) for n in os.listdir(f"{self.base}/kept") if "=" in n)
        self.arrived = 0

    def arrive(self, n: int | None = None) -> None:
        """The next ``n`` files arrive, or all; a file's time says its place."""
        for k in self.waiting[:n]:
            folder = f"{self.base}/kept/_delivery={k}"
            for name in sorted(os.listdir(folder)):
                if name.endswith(".json"):
                    os.utime(f"{folder}/{name}", (1_000_000_000 + 10 * self.arrived,) * 2)
                    os.rename(f"{folder}/{name}", f"{self.base}/log/{k:06d}-{name}")
            self.arrived += 1
        self.waiting = [] if n is None else self.waiting[n:]

    def stream(self, files_per_trigger: int = 1) -> DataFrame:
        return self.spark.readStream.schema(self.schema).option("timestampFormat", MICROS).option("maxFilesPerTrigger", files_per_trigger).json(f"file://{self.base}/log")

    def run(self, writer: Callable[[DataFrame], DataStreamWriter], files_per_trigger: int = 1, stops: int = 2) -> None:
        """Start what ``writer`` makes of the stream, ``stops`` times: a part of the files arrives, is used up, and the query stops.

        Each start but the first goes on from the checkpoint.
        """
        each = -(-len(self.waiting) // stops)
        for _ in range(stops):
            self.arrive(each)
            writer(self.stream(files_per_trigger)).option("checkpointLocation", f"file://{self.base}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def days_apart(ts: str, days: int, first: str) -> Column:
    """The number of the block of ``days`` that a time is in."""
    return F.floor((F.unix_timestamp(F.col(ts)) - F.unix_timestamp(F.lit(first).cast("timestamp"))) / (86_400 * days))
