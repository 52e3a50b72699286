"""Detection quality and naming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import geometry, names
from tidewright.functions.text import grade_name, group_name
from tidewright.operators import detections, tracks
from tidewright.plans.dashboard import read


def _shifted(spark: SparkSession, d: str) -> DataFrame:
    """Pictures with their annotated boxes, and as detections the same boxes shifted by a share of their size that depends on the picture."""
    rows = read(spark, d, "source_records").dropDuplicates(["record_id"]).where("size(annotations) > 0")
    shift = (F.col("record_id") % 11) / 20.0

    def found(a, i):
        b = geometry.box_of(a["points"])
        w = (b["x1"] - b["x0"]) * shift
        moved = F.struct((b["x0"] + w).alias("x0"), b["y0"].alias("y0"), (b["x1"] + w).alias("x1"), b["y1"].alias("y1"))
        return F.struct(a["class_id"].alias("class"), moved.alias("box"), (1 - shift - i * 0.001).alias("score"))

    truth = F.transform("annotations", lambda a: F.struct(a["class_id"].alias("class"), geometry.box_of(a["points"]).alias("box")))
    return rows.select(F.col("record_id").cast("string").alias("picture"), truth.alias("truth"), F.transform("annotations", found).alias("found"))


def detection_precision(spark: SparkSession, d: str) -> DataFrame:
    """Average precision per class at ten thresholds."""
    return detections.average_precision(_shifted(spark, d)).withColumn("ap", F.round("ap", 6))


def object_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Confusion of matched boxes' classes, with background for what was missed or is not there."""
    return detections.objects(_shifted(spark, d)).groupBy("truth", "predicted").agg(F.count("*").alias("n"), F.count_if("duplicate").alias("duplicates"))


def detection_summary(spark: SparkSession, d: str) -> DataFrame:
    return detections.summary(detections.objects(_shifted(spark, d)))


def grade_track_quality(spark: SparkSession, d: str) -> DataFrame:
    """A fish's grades along its frames read as track identifiers: switches, distinct values, frames without one."""
    rows = read(spark, d, "frame_grades").select("session_id", "fish_id", "frame", grade_name(F.col("provisional_grade")).alias("track")).groupBy("session_id", "fish_id", "frame").agg(F.max("track").alias("track"))
    return detections.track_quality(rows, ["session_id", "fish_id"], "frame", "track")


def origin_names(spark: SparkSession, d: str) -> DataFrame:
    """How many records were exported from each picture."""
    rows = read(spark, d, "source_records").select(names.origin_name(F.col("source_path")).alias("origin"), "record_id")
    return rows.groupBy("origin").agg(F.countDistinct("record_id").alias("records"))


def class_count_cells(spark: SparkSession, d: str) -> DataFrame:
    """Annotation counts per picture as a cell, and back: how many pictures have each cell."""
    rows = read(spark, d, "source_records").dropDuplicates(["record_id"]).select(F.array_join(F.transform("annotations", lambda a: F.concat(a["class_id"].cast("string"), F.lit(":1"))), "|").alias("cell"))
    return rows.groupBy(names.cell_of(names.counts_of(F.col("cell"))).alias("cell")).agg(F.count("*").alias("n"))


def path_forms(spark: SparkSession, d: str) -> DataFrame:
    """Per first folder of the paths: pictures by name before augmentation, and the greatest file token, Markdown cell and status token."""
    rows = read(spark, d, "source_records").select("source_path", "source_split", names.first_folder(F.col("source_path")).alias("folder"))
    return rows.groupBy("folder").agg(
        F.countDistinct(names.source_name(F.lit(" "), F.col("source_path"))).alias("pictures"), F.max(names.file_token(F.col("source_path"))).alias("token"),
        F.max(names.markdown_cell(F.concat_ws("|", "source_path", "source_split"))).alias("cell"), F.max(names.status_token(F.col("source_split"))).alias("status"),
    )


def followed_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of a source group's pictures, in the order of their records, followed by overlap: boxes and tracks per group."""
    rows = read(spark, d, "source_records").dropDuplicates(["record_id"]).where("size(annotations) > 0").select(group_name(F.col("source_group")).alias("stream"), "record_id", "width", "height", F.posexplode("annotations").alias("ordinal", "a"))
    box = rows.withColumn("b", geometry.box_of(F.col("a.points")))
    shares = [(F.col(f"b.{c}") / F.col("width" if c[0] == "x" else "height")).alias(c) for c in ("x0", "y0", "x1", "y1")]
    return tracks.follow(box.select("stream", F.col("record_id").alias("frame"), "ordinal", *shares)).groupBy("stream").agg(F.count("*").alias("boxes"), F.countDistinct("track").alias("tracks"))


def tile_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of 640 with an overlap of 64 per picture size."""
    rows = read(spark, d, "source_records").select("width", "height").distinct()
    return rows.select("width", "height", F.size(names.tiles(F.col("width"), F.col("height"), 640, 64)).alias("tiles"))


QUERIES = {f.__name__: f for f in (detection_precision, object_confusion, detection_summary, grade_track_quality, origin_names, class_count_cells, path_forms, followed_boxes, tile_counts)}

_G = r"""case regexp_replace(regexp_replace(lower(regexp_replace(provisional_grade, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), '[\s_\-]+', '', 'g'), '^(class|grade)', '')
  when 'a' then 'Class A' when 'b' then 'Class B' when 'c' then 'Class C' when 'rejected' then 'Rejected' when 'reject' then 'Rejected' end"""

ORACLES = {
    "grade_track_quality": f"""with f as (select session_id, fish_id, frame, max({_G}) as t from frame_grades group by all), w as (select *, last_value(t ignore nulls) over (partition by session_id, fish_id order by frame rows between unbounded preceding and 1 preceding) as b from f)
        select session_id, fish_id, count(*) as frames, count(distinct t) as tracks, count(*) filter (t <> b) as switches, count(*) filter (t is null) as missed from w group by all""",
    "origin_names": r"""select origin, count(distinct record_id) as records from (select record_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(string_split(replace(source_path, chr(92), '/'), '/')[-1]),
        '\.(jpe?g|png|bmp)$', ''), '\.rf\.[0-9a-f]+$', ''), '\.(jpe?g|png|bmp)$', ''), '_(jpe?g|png|bmp)$', '') as origin from source_records) group by origin""",
    "class_count_cells": """select cell, count(*) as n from (select r.record_id, coalesce(string_agg(c || ':' || k, '|' order by c), '') as cell from (select distinct record_id from source_records) r
        left join (select record_id, a.class_id as c, count(*) as k from (select record_id, unnest(annotations) as a from (select distinct on (record_id) * from source_records)) group by all) x using (record_id) group by r.record_id) group by cell""",
    "path_forms": r"""with r as (select *, list_filter(string_split(replace(source_path, chr(92), '/'), '/'), lambda p: p <> '' and p <> '.') as p, string_split(replace(source_path, chr(92), '/'), '/')[-1] as base from source_records)
        select case when len(p) > 1 then p[1] else '' end as folder, count(distinct regexp_replace(regexp_replace(base, '^(.+)\.[^.]*$', '\1'), '\.rf\.[0-9A-Za-z]+$', '')) as pictures, max(regexp_replace(source_path, '[^\p{L}\p{N}\-_]', '_', 'g')) as token,
        max(replace(replace(concat_ws('|', source_path, source_split), '|', chr(92) || '|'), chr(10), ' ')) as cell, max(regexp_replace(lower(coalesce(source_split, '')), '[^\p{L}\p{N}_]', '', 'g')) as status from r group by 1""",
    "tile_counts": """with s as (select distinct width as w, height as h from source_records), n as (select *, case when w <= 640 then 1 else (w - 640) // 576 + 1 + ((w - 640) % 576 > 0)::int end as x, case when h <= 640 then 1 else (h - 640) // 576 + 1 + ((h - 640) % 576 > 0)::int end as y from s)
        select w as width, h as height, (x * y)::int as tiles from n""",
}
