"""Queries over the log of inspections and sessions: filters, paging, counts, series, exports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.numbers import finite, scaled
from tidewright.functions.text import instant
from tidewright.operators import history, store, windows

BUCKETS = ("Class A", "Class B", "Class C", "Rejected", "Ungraded")


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def latest_inspections(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The last version of each inspection, with only the columns asked for read from the file."""
    rows = read(spark, d, "fish_inspections").select("session_id", "track_id", "updated_at", *columns)
    return store.latest(rows, ["session_id", "track_id"], instant(F.col("updated_at")), F.xxhash64(*columns))


def bucket_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Rows per grade in five fixed buckets; a bucket without rows counts 0."""
    rows = read(spark, d, "fish_inspections")
    bucket = F.when(F.col("final_grade").isin(*BUCKETS), F.col("final_grade")).otherwise(BUCKETS[-1])
    counts = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    domain = spark.range(1).select(F.explode(F.array(*map(F.lit, BUCKETS))).alias("bucket"))
    return domain.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def dashboard_counts(spark: SparkSession, d: str) -> DataFrame:
    """All counts and averages of the overview in one pass."""
    regions = F.from_json("observed_regions_json", "array<string>")
    rows = read(spark, d, "fish_inspections").withColumn("seen", F.coalesce(F.size(regions), F.lit(0)))
    return rows.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("final_grade") == "Ungraded").alias("ungraded"),
        F.count_if(F.col("seen") == 1).alias("one_region"),
        F.count_if(F.col("seen") == 2).alias("two_regions"),
        F.count_if(F.col("seen") == 3).alias("three_regions"),
        F.count_if(F.array_contains(regions, "Body")).alias("with_body"),
        F.round(F.avg(finite(F.col("final_support"))) * 100, 8).alias("avg_support"),
        F.round(F.avg(finite(F.col("grade_margin"))) * 100, 8).alias("avg_margin"),
        F.round(F.avg(finite(F.col("processing_time_ms"))), 8).alias("avg_ms"),
    )


def pivot_averages(spark: SparkSession, d: str) -> DataFrame:
    """Average support by tracker backend, one column per grade."""
    sessions = read(spark, d, "inspection_sessions").select("session_id", F.coalesce("tracker_backend", F.lit("none")).alias("backend"))
    rows = read(spark, d, "fish_inspections").select("session_id", "final_grade", finite(F.col("final_support")).alias("support"))
    out = rows.join(sessions, "session_id").groupBy("backend").pivot("final_grade", list(BUCKETS)).agg(F.round(F.avg("support"), 10))
    return out.withColumnsRenamed({b: b.lower().replace(" ", "_") for b in BUCKETS})


def range_filter_custom(spark: SparkSession, d: str) -> DataFrame:
    rows = history.between_days(read(spark, d, "fish_inspections"), "ts", date(2031, 3, 1), date(2031, 6, 30))
    return rows.groupBy(history.wall_date(F.col("ts")).alias("day")).agg(F.count("*").alias("n"))


def history_filters(spark: SparkSession, d: str) -> DataFrame:
    """Text search, grade, region in the observed ones, and least support together."""
    rows = history.id_search(read(spark, d, "fish_inspections"), "track_id", "Fish #1")
    rows = rows.where(history.same_text(F.col("final_grade"), "class b"))
    rows = rows.where(F.exists(F.from_json("observed_regions_json", "array<string>"), lambda r: F.lower(r) == "tail"))
    rows = rows.where(history.at_least(40, F.col("final_support"), F.col("second_support"), F.col("model1_confidence")))
    return rows.select("session_id", "track_id", "updated_at", "final_support").distinct()


def page_of_history(spark: SparkSession, d: str) -> DataFrame:
    """The third page of 25, newest text first, in a total order."""
    rows = read(spark, d, "fish_inspections").select("session_id", "track_id", "ts", "updated_at").distinct()
    return history.page(rows, [F.desc("ts"), F.desc("updated_at"), F.asc("session_id"), F.asc("track_id")], 3, 25)


def page_counts(spark: SparkSession, d: str) -> DataFrame:
    return history.page_counts(read(spark, d, "fish_inspections"), 25)


def newest_sessions(spark: SparkSession, d: str) -> DataFrame:
    return history.newest(read(spark, d, "inspection_sessions").select("session_id", "started_at"), [F.desc("started_at"), F.asc("session_id")], 50)


def newest_per_session(spark: SparkSession, d: str) -> DataFrame:
    """The five inspections of each session whose time text sorts last."""
    rows = read(spark, d, "fish_inspections").select("session_id", "track_id", "ts").distinct()
    return history.newest_in_group(rows, ["session_id"], [F.desc("ts"), F.asc("track_id")], 5)


def latest_versions(spark: SparkSession, d: str) -> DataFrame:
    return latest_inspections(spark, d, "final_grade").select("session_id", "track_id", "updated_at", "final_grade")


def partial_update_merge(spark: SparkSession, d: str) -> DataFrame:
    """Sessions after an update that supplies some members; an end once written stays."""
    sessions = read(spark, d, "inspection_sessions").select("session_id", "started_at", "ended_at", "git_commit", "tracker_backend")
    update = sessions.where(F.col("git_commit").isNull() | F.col("ended_at").isNull()).select(
        "session_id", F.col("started_at").alias("ended_at"), F.lit("patched").alias("git_commit"), F.lit(None).cast("string").alias("tracker_backend")
    )
    return store.merge(sessions, update, ["session_id"], first_write_wins=("ended_at",))


def session_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Fish with graded frames but without inspection, per session."""
    frames = read(spark, d, "frame_grades").select("session_id", F.col("fish_id").alias("track_id")).distinct()
    return store.orphans(frames, read(spark, d, "fish_inspections"), ["session_id", "track_id"]).groupBy("session_id").agg(F.count("*").alias("n"))


def repeated_versions(spark: SparkSession, d: str) -> DataFrame:
    return store.duplicate_keys(read(spark, d, "fish_inspections"), ["session_id", "track_id"])


def fish_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Fish in frames and in inspections: how many in one, the other, or both."""
    frames = read(spark, d, "frame_grades").select("session_id", F.col("fish_id").alias("track_id")).distinct()
    inspected = read(spark, d, "fish_inspections").select("session_id", "track_id").distinct()
    return store.compare(frames, inspected, ["session_id", "track_id"]).groupBy("status").agg(F.count("*").alias("n"))


def throughput(spark: SparkSession, d: str) -> DataFrame:
    """Running number of latest inspections over time; ordered without gathering them in one task."""
    rows = latest_inspections(spark, d, "ts").select("session_id", "track_id", instant(F.col("ts")).alias("at"))
    return windows.running_number(rows, F.date_trunc("day", "at"), [F.asc("at"), F.asc("session_id"), F.asc("track_id")], "running")


def export_rows(spark: SparkSession, d: str) -> DataFrame:
    """The export's columns: percentages rounded half to even, texts with defaults, lists joined."""
    regions = F.from_json("observed_regions_json", "array<string>")
    return latest_inspections(spark, d, "final_grade", "observed_regions_json", "final_support", "second_grade").select(
        "session_id", "track_id",
        F.coalesce(F.nullif("final_grade", F.lit("")), F.lit("Ungraded")).alias("grade"),
        F.concat_ws(", ", F.array_sort(F.array_distinct(F.coalesce(regions, F.array().cast("array<string>"))))).alias("regions"),
        scaled(F.col("final_support"), 100, 3).alias("support_percent"),
        F.coalesce("second_grade", F.lit("")).alias("second_grade"),
    )


def reason_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Reasons of ungraded rows, and how many have none."""
    rows = read(spark, d, "fish_inspections").where("final_grade = 'Ungraded'")
    reasons = F.coalesce(F.from_json("reason_codes_json", "array<string>"), F.array().cast("array<string>"))
    each = rows.select(F.explode(F.when(F.size(reasons) > 0, F.array_distinct(reasons)).otherwise(F.array(F.lit("WITHOUT_REASON")))).alias("reason"))
    return each.groupBy("reason").agg(F.count("*").alias("n"))


def session_durations(spark: SparkSession, d: str) -> DataFrame:
    """Closed sessions per backend: number and duration in seconds, from texts with offsets."""
    rows = read(spark, d, "inspection_sessions").select("tracker_backend", (F.unix_seconds(instant(F.col("ended_at"))) - F.unix_seconds(instant(F.col("started_at")))).alias("s"))
    return rows.groupBy(F.coalesce("tracker_backend", F.lit("none")).alias("backend")).agg(F.count("*").alias("sessions"), F.count("s").alias("closed"), F.min("s").alias("shortest"), F.max("s").alias("longest"))


QUERIES = {
    f.__name__: f
    for f in (
        bucket_distribution, dashboard_counts, pivot_averages, range_filter_custom, history_filters, page_of_history, page_counts, newest_sessions, newest_per_session,
        latest_versions, partial_update_merge, session_orphans, repeated_versions, fish_comparison, throughput, export_rows, reason_histogram, session_durations,
    )
}

_BUCKET_ROWS = ", ".join(f"('{b}')" for b in BUCKETS)
_VERSION = "try_cast(updated_at as timestamptz)"
_LATEST = f"(select * from (select *, row_number() over (partition by session_id, track_id order by {_VERSION} desc nulls last) as rn from fish_inspections) where rn = 1)"
_REGIONS = "try_cast(observed_regions_json as json)::varchar[]"

ORACLES = {
    "bucket_distribution": f"""select bucket, count(f.b)::bigint as n from (values {_BUCKET_ROWS}) v(bucket)
        left join (select case when final_grade in ({', '.join(repr(b) for b in BUCKETS)}) then final_grade else 'Ungraded' end as b from fish_inspections) f on f.b = bucket group by bucket""",
    "dashboard_counts": f"""select count(*) as rows, count(*) filter (final_grade = 'Ungraded') as ungraded, count(*) filter (len({_REGIONS}) = 1) as one_region, count(*) filter (len({_REGIONS}) = 2) as two_regions,
        count(*) filter (len({_REGIONS}) = 3) as three_regions, count(*) filter (list_contains({_REGIONS}, 'Body')) as with_body, round(avg(final_support) filter (isfinite(final_support)) * 100, 8) as avg_support,
        round(avg(grade_margin) filter (isfinite(grade_margin)) * 100, 8) as avg_margin, round(avg(processing_time_ms) filter (isfinite(processing_time_ms)), 8) as avg_ms from fish_inspections""",
    "pivot_averages": "select backend, " + ", ".join(f"round(avg(s) filter (final_grade = '{b}'), 10) as {b.lower().replace(' ', '_')}" for b in BUCKETS) + """ from (select coalesce(tracker_backend, 'none') as backend, final_grade,
        case when isfinite(final_support) then final_support end as s from fish_inspections join inspection_sessions using (session_id)) group by backend""",
    "range_filter_custom": "select try_cast(ts[1:10] as date) as day, count(*) as n from fish_inspections where try_cast(ts[1:10] as date) between date '2031-03-01' and date '2031-06-30' group by day",
    "history_filters": f"""select distinct session_id, track_id, updated_at, final_support from fish_inspections where contains(track_id::varchar, '1') and lower(coalesce(nullif(final_grade, ''), 'Ungraded')) = 'class b'
        and list_contains(list_transform({_REGIONS}, lambda r: lower(r)), 'tail') and coalesce(case when isfinite(final_support) then final_support end, case when isfinite(second_support) then second_support end, case when isfinite(model1_confidence) then model1_confidence end, 0) * 100 >= 40""",
    "page_of_history": "select distinct session_id, track_id, ts, updated_at from fish_inspections order by ts desc, updated_at desc, session_id, track_id limit 25 offset 50",
    "page_counts": "select count(*) as total, greatest(ceil(count(*) / 25.0), 1)::bigint as total_pages from fish_inspections",
    "newest_sessions": "select session_id, started_at from inspection_sessions order by started_at desc, session_id limit 50",
    "newest_per_session": "select session_id, track_id, ts from (select distinct session_id, track_id, ts from fish_inspections) qualify row_number() over (partition by session_id order by ts desc, track_id) <= 5",
    "latest_versions": f"select session_id, track_id, updated_at, final_grade from {_LATEST}",
    "partial_update_merge": """select session_id, started_at, coalesce(ended_at, started_at) as ended_at, case when git_commit is null or ended_at is null then 'patched' else git_commit end as git_commit, tracker_backend from inspection_sessions""",
    "session_orphans": "select session_id, count(*) as n from (select distinct session_id, fish_id as track_id from frame_grades) f anti join fish_inspections i using (session_id, track_id) group by session_id",
    "repeated_versions": "select session_id, track_id, count(*) as rows from fish_inspections group by all having count(*) > 1",
    "fish_comparison": """select case when i.t is null then 'left_only' when f.t is null then 'right_only' else 'same' end as status, count(*) as n
        from (select distinct session_id as s, fish_id as t from frame_grades) f full join (select distinct session_id as s, track_id as t from fish_inspections) i on f.s = i.s and f.t = i.t group by status""",
    "throughput": f"select session_id, track_id, (ts::timestamptz at time zone 'UTC') as at, row_number() over (order by ts::timestamptz, session_id, track_id) as running from {_LATEST}",
    "export_rows": f"""select session_id, track_id, coalesce(nullif(final_grade, ''), 'Ungraded') as grade, array_to_string(list_sort(list_distinct({_REGIONS})), ', ') as regions,
        round_even(case when isfinite(final_support) then final_support end * 100, 3) as support_percent, coalesce(second_grade, '') as second_grade from {_LATEST}""",
    "reason_histogram": """select reason, count(*) as n from (select unnest(case when len(r) > 0 then list_distinct(r) else ['WITHOUT_REASON'] end) as reason
        from (select coalesce(try_cast(reason_codes_json as json)::varchar[], []) as r from fish_inspections where final_grade = 'Ungraded')) group by reason""",
    "session_durations": """select coalesce(tracker_backend, 'none') as backend, count(*) as sessions, count(s) as closed, min(s) as shortest, max(s) as longest from (select tracker_backend,
        epoch(ended_at::timestamptz)::bigint - epoch(started_at::timestamptz)::bigint as s from inspection_sessions) group by backend""",
}
