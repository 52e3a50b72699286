"""Queries over the nested documents of inspections (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import flatten


def _children(spark: SparkSession, d: str) -> DataFrame:
    return flatten.children(spark.read.parquet(f"{d}/fish_inspections.parquet"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return flatten.found(spark.read.parquet(f"{d}/fish_inspections.parquet"))


def p5_detections(spark: SparkSession, d: str) -> DataFrame:
    """The detections' table; boxes and masks as JSON."""
    return flatten.table(_children(spark, d), "detection").drop("payload").withColumns({"bbox": F.to_json("bbox"), "mask": F.to_json("mask")})


def p5_parts(spark: SparkSession, d: str) -> DataFrame:
    """The parts' table with their statistics over time."""
    s = F.col("temporal_statistics")
    rows = flatten.table(_children(spark, d), "part")
    return rows.select("*", s["region_observation_count"].alias("region_observation_count"), s["top_grade_statistics"]["standard_deviation"].alias("top_grade_standard_deviation")).drop("temporal_statistics")


def p5_evidence(spark: SparkSession, d: str) -> DataFrame:
    return flatten.table(_children(spark, d), "evidence")


def p5_scores(spark: SparkSession, d: str) -> DataFrame:
    return flatten.table(_children(spark, d), "score")


def p5_colors(spark: SparkSession, d: str) -> DataFrame:
    return flatten.table(_children(spark, d), "color")


def p5_rois(spark: SparkSession, d: str) -> DataFrame:
    """The ROIs' table; boxes as JSON."""
    return flatten.table(_children(spark, d), "roi").withColumn("crop_local_bbox", F.to_json("crop_local_bbox"))


def p5_rest(spark: SparkSession, d: str) -> DataFrame:
    """Members of the documents that belong to no child, as JSON."""
    return flatten.table(_children(spark, d), "rest")


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    """Per table: children, distinct keys, and children whose parent is in no table."""
    rows = _children(spark, d)
    keys = rows.select(F.col("node_id").alias("parent_id")).distinct()
    top = F.concat_ws("/", F.coalesce("session_id", F.lit("~")), F.coalesce(F.col("track_id").cast("string"), F.lit("~")))
    orphans = rows.where(F.col("parent_id") != top).join(keys, "parent_id", "left_anti").groupBy("tag").agg(F.count("*").alias("orphans"))
    return rows.groupBy("tag").agg(F.count("*").alias("children"), F.countDistinct("node_id").alias("keys")).join(orphans, "tag", "left").na.fill(0, ["orphans"])


QUERIES = {f.__name__: f for f in (p5_found, p5_detections, p5_parts, p5_evidence, p5_scores, p5_colors, p5_rois, p5_rest, p5_links)}

_REGION = "case trim(regexp_replace(lower({0}), '[\\s_\\-]+', ' ', 'g')) when 'body' then 'Body' when 'head' then 'Head' when 'tail' then 'Tail' when 'whole fish' then 'Whole Fish' end"
_GRADE = "case trim(regexp_replace(lower({0}), '[\\s_\\-]+', ' ', 'g')) when 'class a' then 'Class A' when 'class b' then 'Class B' when 'class c' then 'Class C' when 'rejected' then 'Rejected' end"
_NUMERIC = "(json_type(value) in ('DOUBLE', 'UBIGINT', 'BIGINT') or (json_type(value) = 'VARCHAR' and regexp_full_match(value ->> '$', '\\s*[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?\\s*')))"


def _document(c: str) -> str:
    """The document, taken out of up to two outer texts."""
    once = f"(case when json_valid({c}) then {c}::json end)"
    inner = f"(case when json_type({once}) = 'VARCHAR' then (case when json_valid({once} ->> '$') then ({once} ->> '$')::json end) else {once} end)"
    return inner


def _regions(name: str, wrapped: str) -> str:
    """Objects by region in the three layouts."""
    return f"""{name}_doc as (select session_id, track_id, case when json_type(doc -> '$.regions') in ('OBJECT', 'ARRAY') then doc -> '$.regions' else doc end as doc
  from (select session_id, track_id, {_document(wrapped)} as doc from last)),
{name} as (select distinct on (session_id, track_id, region) session_id, track_id, region, value from (
  select session_id, track_id, {_REGION.format("key")} as region, value from {name}_doc, lateral (select key, value from json_each(doc)) where json_type(doc) = 'OBJECT'
  union all select session_id, track_id, {_REGION.format("(value ->> '$.region')")}, value from {name}_doc, lateral (select value from json_each(doc)) where json_type(doc) = 'ARRAY' and json_type(value) = 'OBJECT')
  where region is not null and json_type(value) = 'OBJECT')"""


def _objects(source: str, member: str, child: str) -> str:
    return f"""select session_id, track_id, '{child}' as child, region, key as item from (select session_id, track_id, region, value -> '$.{member}' as m from {source}), lateral (select key, value from json_each(m)) x
  where json_type(m) = 'ARRAY' and json_type(x.value) = 'OBJECT'
union all select session_id, track_id, '{child}', region, '0' from {source} where json_type(value -> '$.{member}') = 'OBJECT'"""


ORACLES = {
    "p5_found": f"""with last as (select * from (select *, row_number() over (partition by session_id, track_id order by try_cast(updated_at as timestamptz) desc nulls last) as rn from fish_inspections) where rn = 1),
{_regions("part", "part_results_json")},
{_regions("color", "color_measurements_json")},
score_doc as (select session_id, track_id, case when json_type(doc -> '$.scores') = 'OBJECT' then doc -> '$.scores' else doc end as doc from (select session_id, track_id, {_document("weighted_scores_json")} as doc from last))
select distinct * from (
select session_id, track_id, 'part' as child, region, '' as item from part
union all select session_id, track_id, 'color', region, '' from color
union all select session_id, track_id, 'evidence', region, {_GRADE.format("key")} from (select session_id, track_id, region, value -> '$.grade_evidence' as m from part), lateral (select key, value from json_each(m)) where json_type(m) = 'OBJECT' and {_NUMERIC}
union all select session_id, track_id, 'score', '', {_GRADE.format("key")} from score_doc, lateral (select key, value from json_each(doc)) where json_type(doc) = 'OBJECT' and {_NUMERIC}
union all {_objects("part", "detections", "detection")}
union all {_objects("color", "frame_rois", "roi")}
) where item is not null""",
}
