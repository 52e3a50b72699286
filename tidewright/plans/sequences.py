"""Queries over ordered frames and events: sessions, crossings, windows, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.text import grade_name
from tidewright.operators import windows
from tidewright.plans.dashboard import read


def running_total(spark: SparkSession, d: str) -> DataFrame:
    """Orders so far at each order, in the whole table's order of date and key."""
    rows = read(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return windows.running_number(rows, F.date_trunc("day", F.col("o_orderdate").cast("timestamp")), [F.asc("o_orderdate"), F.asc("o_orderkey")]).select("o_orderkey", "running")


def sessions_by_timeout(spark: SparkSession, d: str) -> DataFrame:
    """Each user's visits: a gap of more than six hours starts a new one."""
    rows = windows.with_sessions(read(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp")), ["user_id"], "at", F.lit(6 * 3600.0), "event_id")
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.unix_micros(F.min("at")).alias("first_us"), F.unix_micros(F.max("at")).alias("last_us"))


def line_crossings(spark: SparkSession, d: str) -> DataFrame:
    """Each user's first event that crosses the line of 60 from below."""
    rows = read(spark, d, "events").select("user_id", "event_id", "ts", "value")
    return windows.first_crossings(rows, ["user_id"], "ts", "event_id", "value", 60.0).select("user_id", "event_id", "value")


def strongest_per_minute(spark: SparkSession, d: str) -> DataFrame:
    """The strongest event per user and minute, the first on ties."""
    rows = read(spark, d, "events").withColumn("minute", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60))
    best = rows.groupBy("user_id", "minute").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"))
    return best


def evidence_since_reset(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the last eight events since a user's last error; errors themselves are not usable."""
    kind = F.col("event_type") == F.min("event_type").over(_whole())
    rows = windows.with_segments(read(spark, d, "events").withColumn("reset", kind), ["user_id"], ["ts", "event_id"], F.col("reset"))
    out = windows.trailing_mean(rows, ["user_id", "segment"], ["ts", "event_id"], F.col("value"), ~F.col("reset"), 8, "evidence")
    return out.select("event_id", "segment", F.round("evidence", 6).alias("evidence"))


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy("user_id")


def calls_in_trailing_hour(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    n = F.expr("count(*) over (partition by user_id order by s range between 3600 preceding and current row)")
    return rows.select("event_id", n.alias("n"))


def smoothed_values(spark: SparkSession, d: str) -> DataFrame:
    """Exponential smoothing and decayed maximum along each user's events.

    Both folds have closed forms in the number of later events, so that they are
    sums and maxima and no user's events are gathered.
    """
    rows = read(spark, d, "events").select("user_id", "value", F.expr("row_number() over (partition by user_id order by ts desc, event_id desc) - 1 as later"))
    last = rows.groupBy("user_id").agg(F.max("later").alias("first_later"))
    keep = F.lit(0.85)
    weight = F.pow(keep, F.col("later")) * F.when(F.col("later") == F.col("first_later"), 1.0).otherwise(1 - keep)
    out = rows.join(last, "user_id").groupBy("user_id").agg(F.sum(weight * F.col("value")).alias("smoothed"), F.max(F.pow(F.lit(0.98), F.col("later")) * F.col("value")).alias("decayed"))
    return out.select("user_id", F.round("smoothed", 6).alias("smoothed"), F.round(F.greatest("decayed", F.lit(0.0)), 6).alias("decayed"))


def sampled_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames of each fish that are graded if one is at least 30 frames after the last graded one."""
    return windows.gate(read(spark, d, "frame_grades"), ["session_id", "fish_id"], "frame", 30, "session_id string, fish_id bigint")


def grade_switches(spark: SparkSession, d: str) -> DataFrame:
    """How often consecutive graded frames of a fish change their grade."""
    rows = read(spark, d, "frame_grades").select("session_id", "fish_id", "frame", grade_name(F.col("provisional_grade")).alias("grade")).where("grade is not null").groupBy("session_id", "fish_id", "frame").agg(F.max("grade").alias("grade"))
    before = F.expr("lag(grade) over (partition by session_id, fish_id order by frame)")
    return rows.withColumn("b", before).groupBy("session_id", "fish_id").agg(F.count_if(F.col("b") != F.col("grade")).alias("switches"), F.count("*").alias("frames"))


def fish_lifetimes(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "frame_grades")
    us = F.unix_micros(F.col("observed_at").cast("timestamp"))
    return rows.groupBy("session_id", "fish_id").agg(F.count("*").alias("rows"), F.countDistinct("frame").alias("frames"), (F.max(us) - F.min(us)).alias("lifetime_us"))


def late_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows received after a row of a later frame of the same fish."""
    best = F.expr("max(frame) over (partition by session_id, fish_id order by received_at range between unbounded preceding and interval '1 microsecond' preceding)")
    rows = read(spark, d, "frame_grades").withColumn("received_at", F.col("received_at").cast("timestamp")).withColumn("seen", best)
    return rows.groupBy("session_id").agg(F.count_if(F.col("frame") < F.col("seen")).alias("late"), F.count("*").alias("rows"))


def vote_of_frames(spark: SparkSession, d: str) -> DataFrame:
    """Grade of each fish by summed confidence; more frames, then the name, settle ties."""
    rows = read(spark, d, "frame_grades").select("session_id", "fish_id", grade_name(F.col("provisional_grade")).alias("grade"), F.round(F.col("detection_confidence") * 1000).cast("bigint").alias("c")).where("grade is not null and c is not null")
    votes = rows.groupBy("session_id", "fish_id", "grade").agg(F.sum("c").alias("total"), F.count("*").alias("n"))
    best = votes.groupBy("session_id", "fish_id").agg(F.max(F.struct("total", "n", "grade")).alias("m"))
    return best.select("session_id", "fish_id", "m.grade", "m.total", "m.n")


QUERIES = {
    f.__name__: f
    for f in (
        running_total, sessions_by_timeout, line_crossings, strongest_per_minute, evidence_since_reset, calls_in_trailing_hour, smoothed_values, sampled_frames, grade_switches, fish_lifetimes, late_rows, vote_of_frames,
    )
}

_G = r"""case regexp_replace(regexp_replace(lower(regexp_replace(provisional_grade, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), '[\s_\-]+', '', 'g'), '^(class|grade)', '')
  when 'a' then 'Class A' when 'b' then 'Class B' when 'c' then 'Class C' when 'rejected' then 'Rejected' when 'reject' then 'Rejected' end"""

ORACLES = {
    "running_total": "select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as running from orders",
    "sessions_by_timeout": """select user_id, session, count(*) as events, epoch_us(min(ts)) as first_us, epoch_us(max(ts)) as last_us from (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as session
        from (select *, case when lag(ts) over w is null or epoch_us(ts) - epoch_us(lag(ts) over w) > 21600000000 then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id))) group by user_id, session""",
    "line_crossings": """select user_id, event_id, value from (select *, lag(value) over w as before from events window w as (partition by user_id order by ts, event_id)) where before < 60 and value >= 60
        qualify row_number() over (partition by user_id order by ts, event_id) = 1""",
    "strongest_per_minute": "select user_id, epoch_us(ts) // 60000000 as minute, arg_max(event_id, (value, -event_id)) as event_id from events group by all",
    "evidence_since_reset": """with e as (select *, event_type = min(event_type) over (partition by user_id) as reset from events), s as (select *, sum(case when reset then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as segment from e)
        select event_id, segment, round(avg(case when not reset then value end) over (partition by user_id, segment order by ts, event_id rows between 7 preceding and current row), 6) as evidence from s""",
    "calls_in_trailing_hour": "select event_id, count(*) over (partition by user_id order by epoch_us(ts) // 1000000 range between 3600 preceding and current row) as n from events",
    "smoothed_values": """select user_id, round(list_reduce(v, lambda a, x: a * 0.85 + x * (1 - 0.85)), 6) as smoothed, round(list_reduce(list_prepend(0.0, v), lambda a, x: greatest(a * (1 - 0.02), x)), 6) as decayed
        from (select user_id, list(value order by ts, event_id) as v from events group by user_id)""",
    "grade_switches": f"""with g as (select session_id, fish_id, frame, max({_G}) as grade from frame_grades group by all having grade is not null)
        select session_id, fish_id, count(*) filter (b <> grade) as switches, count(*) as frames from (select *, lag(grade) over (partition by session_id, fish_id order by frame) as b from g) group by all""",
    "fish_lifetimes": "select session_id, fish_id, count(*) as rows, count(distinct frame) as frames, epoch_us(max(observed_at)) - epoch_us(min(observed_at)) as lifetime_us from frame_grades group by all",
    "late_rows": """select session_id, count(*) filter (frame < seen) as late, count(*) as rows from (select *, max(frame) over (partition by session_id, fish_id order by received_at range between unbounded preceding and interval 1 microsecond preceding) as seen from frame_grades) group by session_id""",
    "vote_of_frames": f"""with r as (select session_id, fish_id, {_G} as grade, round(detection_confidence * 1000)::bigint as c from frame_grades), v as (select session_id, fish_id, grade, sum(c)::bigint as total, count(*) as n from r where grade is not null and c is not null group by all)
        select session_id, fish_id, grade, total, n from v qualify row_number() over (partition by session_id, fish_id order by total desc, n desc, grade desc) = 1""",
}
