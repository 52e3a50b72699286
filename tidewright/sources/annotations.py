"""Label files and annotation documents as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path)
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("image_id"), F.trim("value").alias("line")).where("line <> ''")


def _numbers(line: Column) -> Column:
    return F.transform(F.split(line, r"\s+"), lambda t: t.try_cast("double"))


def read_boxes(spark: SparkSession, path: str, classes: int) -> DataFrame:
    """Lines of class, centre and size (shares of the picture), with the issues of each line."""
    rows = _lines(spark, path).withColumn("n", _numbers(F.col("line")))
    n = F.col("n")
    whole = (n[0] >= 0) & (n[0] < classes) & (n[0] == F.floor(n[0]))
    inside = F.forall(F.slice(n, 2, 4), lambda v: (v >= 0) & (v <= 1)) & (n[3] > 0) & (n[4] > 0)
    issues = F.array_compact(F.array(
        F.when(F.size(n) != 5, "tokens"), F.when(F.exists(n, lambda v: v.isNull()), "not_numeric"),
        F.when((F.size(n) == 5) & ~F.coalesce(whole, F.lit(False)), "class"), F.when((F.size(n) == 5) & ~F.coalesce(inside, F.lit(False)), "range"),
    ))
    get = lambda i: F.get("n", F.lit(i))
    box = F.struct((get(1) - get(3) / 2).alias("x0"), (get(2) - get(4) / 2).alias("y0"), (get(1) + get(3) / 2).alias("x1"), (get(2) + get(4) / 2).alias("y1"))
    return rows.select("image_id", "line", issues.alias("issues"), get(0).cast("int").alias("class"), box.alias("box"))


def read_polygons(spark: SparkSession, path: str, classes: int) -> DataFrame:
    """Lines of class and at least three points (shares of the picture), with the issues of each line."""
    rows = _lines(spark, path).withColumn("n", _numbers(F.col("line")))
    n, points = F.col("n"), F.expr("slice(n, 2, greatest(size(n) - 1, 0))")
    issues = F.array_compact(F.array(
        F.when((F.size(n) < 7) | (F.size(n) % 2 == 0), "tokens"), F.when(F.exists(n, lambda v: v.isNull()), "not_numeric"),
        F.when(~F.coalesce((n[0] >= 0) & (n[0] < classes) & (n[0] == F.floor(n[0])), F.lit(False)), "class"), F.when(F.exists(points, lambda v: (v < 0) | (v > 1)), "range"),
    ))
    return rows.select("image_id", "line", issues.alias("issues"), n[0].cast("int").alias("class"), points.alias("points"))


COCO = (
    "images array<struct<id:bigint, file_name:string, width:int, height:int>>, categories array<struct<id:bigint, name:string>>, "
    "annotations array<struct<id:bigint, image_id:bigint, category_id:bigint, bbox:array<double>, segmentation:string>>"
)


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """One row per annotation of a COCO document, joined to its image and category; ends that are missing are null."""
    doc = spark.read.schema(COCO).option("multiLine", True).json(path)
    part = lambda name: doc.select(F.explode(name).alias("x")).select("x.*")
    images = part("images").withColumnsRenamed({"id": "image_id"})
    categories = part("categories").withColumnsRenamed({"id": "category_id", "name": "category"})
    return part("annotations").withColumnRenamed("id", "annotation_id").join(images, "image_id", "left").join(categories, "category_id", "left")
