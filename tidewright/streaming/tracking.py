"""Streams: hourly windows with late data, and crossings with keyed state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewright.operators import store
from tidewright.session import ensure_checkpoint_dir

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CROSSINGS = "user_id bigint, event_id bigint, at_us bigint, value double"


def source(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a folder of Parquet files or one file."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def hourly(events: DataFrame, delay: str = "30 days") -> DataFrame:
    """Events per type and hour; rows later than ``delay`` are too late."""
    at = F.col("ts").cast("timestamp").alias("at")
    rows = events.select("event_type", "value", at).withWatermark("at", delay)
    return rows.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


class CrossingTracker(StatefulProcessor):
    """Emits each key's first crossing of the line; a gap beyond the timeout starts a new visit.

    State per key: last value, last time and whether the visit's crossing was
    emitted. Rows of a batch are taken in the order of time and id.
    """

    def __init__(self, line: float, timeout_us: int) -> None:
        self.line, self.timeout_us = line, timeout_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("visit", "value double, at_us bigint, emitted boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        batch = pd.concat(list(rows)).sort_values(["at_us", "event_id"])
        value, at, emitted = self.state.get() if self.state.exists() else (None, None, False)
        out = []
        for event_id, now, v in zip(batch["event_id"], batch["at_us"], batch["value"]):
            if at is not None and now - at > self.timeout_us:
                value, emitted = None, False
            if not emitted and value is not None and value < self.line <= v:
                out.append((key[0], int(event_id), int(now), float(v)))
                emitted = True
            value, at = float(v), int(now)
        self.state.update((value, at, emitted))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "at_us", "value"])

    def close(self) -> None:
        pass


def crossings(events: DataFrame, line: float, timeout_us: int) -> DataFrame:
    rows = events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "value")
    return rows.groupBy("user_id").transformWithStateInPandas(CrossingTracker(line, timeout_us), CROSSINGS, "Append", "None")


def run_to_files(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what its source has now, into Parquet files in the shared folder, and read them."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_complete(stream: DataFrame, name: str) -> DataFrame:
    """Run an aggregating stream over what its source has now; the last complete result."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


def run_upserts(stream: DataFrame, path: str, keys: list[str], order: str) -> None:
    """Keep the latest row per key of a stream in the store at ``path``, batch by batch."""
    base = f"{ensure_checkpoint_dir(stream.sparkSession)}/stream-upsert-{uuid.uuid4().hex}"

    def write(batch: DataFrame, _: int) -> None:
        store.upsert(batch, path, keys, F.col(order))

    stream.writeStream.foreachBatch(write).option("checkpointLocation", base).trigger(availableNow=True).start().awaitTermination()
