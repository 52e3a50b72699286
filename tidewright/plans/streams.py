"""Streaming forms of batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.streaming import tracking

LINE, TIMEOUT_US = 60.0, 6 * 3_600_000_000


def stream_crossings(spark: SparkSession, d: str) -> DataFrame:
    """The first crossing of each visit, by keyed state; the state store is RocksDB."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, tracking.ROCKS)
    try:
        return tracking.run_to_files(tracking.crossings(tracking.source(spark, f"{d}/events.parquet"), LINE, TIMEOUT_US), "crossings")
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def stream_upserts(spark: SparkSession, d: str) -> DataFrame:
    """The latest event of each user and type, kept by upserts of micro-batches."""
    path = f"{tracking.ensure_checkpoint_dir(spark)}/store-{tracking.uuid.uuid4().hex}"
    tracking.run_upserts(tracking.source(spark, f"{d}/events.parquet").select("user_id", "event_type", "event_id", "ts", "value"), path, ["user_id", "event_type"], "ts")
    return tracking.store.read_current(spark, path).select("user_id", "event_type", "event_id", "value")


def stream_hours(spark: SparkSession, d: str) -> DataFrame:
    """Events per type and hour window by a streaming aggregation; equal to the batch form."""
    out = tracking.run_complete(tracking.hourly(tracking.source(spark, f"{d}/events.parquet")), "hours")
    return out.select(F.unix_seconds("w.start").alias("start_s"), "event_type", "n", F.round("value", 4).alias("value"))


QUERIES = {f.__name__: f for f in (stream_crossings, stream_upserts, stream_hours)}

ORACLES = {
    "stream_hours": "select epoch(time_bucket(interval 1 hour, ts))::bigint as start_s, event_type, count(*) as n, round(sum(value), 4) as value from events group by all",
    "stream_crossings": f"""with e as (select *, epoch_us(ts) as at_us, lag(value) over w as before, epoch_us(lag(ts) over w) as before_us from events window w as (partition by user_id order by ts, event_id)),
        s as (select *, sum(case when before_us is null or at_us - before_us > {TIMEOUT_US} then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as visit from e)
        select user_id, event_id, at_us, value from s where before < {LINE} and value >= {LINE} and at_us - before_us <= {TIMEOUT_US} qualify row_number() over (partition by user_id, visit order by ts, event_id) = 1""",
    "stream_upserts": "select user_id, event_type, arg_max(event_id, ts) as event_id, arg_max(value, ts) as value from events group by all",
}
