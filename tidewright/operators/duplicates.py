"""Exact and near duplicates."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.geometry import hamming


def exact_groups(df: DataFrame, key: Column, order: str, label: Column) -> DataFrame:
    """Groups of more than one row with equal key: first row, size, and whether labels differ. No window over a group."""
    return (
        df.select(key.alias("key"), F.col(order).alias("o"), label.alias("l"))
        .where("key is not null")
        .groupBy("key")
        .agg(F.min("o").alias("canonical"), F.count("*").alias("size"), (F.min("l") != F.max("l")).alias("mixed_labels"))
        .where("size > 1")
    )


def near_codes(codes: DataFrame, code: str, distance: int, agreeing: int = 2) -> DataFrame:
    """(a, b, distance): distinct 64-bit codes a < b that differ in at most ``distance`` bits, each pair once.

    The code is cut into distance + agreeing bands; of these at least
    ``agreeing`` agree, so every choice of that many bands is a key. More
    agreeing bands make longer keys: fewer candidates meet, under more keys
    each. Rows that share a code are one code here, so that no hot code multiplies.
    """
    bands = distance + agreeing
    edges = [64 * i // bands for i in range(bands + 1)]
    parts = [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]
    keys = []
    for n, chosen in enumerate(combinations(parts, agreeing)):
        key = F.lit(0).cast("long")
        for lo, width in chosen:
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(code, lo).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(F.struct(F.lit(n).alias("n"), key.alias("k")))
    banded = codes.where(F.col(code).isNotNull()).select(code).distinct().select(code, F.explode(F.array(*keys)).alias("b")).select(code, "b.n", "b.k")
    left, right = banded.withColumnRenamed(code, "a"), banded.withColumnRenamed(code, "b")
    return left.join(right, ["n", "k"]).where("a < b").select("a", "b", hamming(F.col("a"), F.col("b")).alias("distance")).where(F.col("distance") <= distance).distinct()


def crossing_values(df: DataFrame, kinds: dict[str, Column], part: Column) -> DataFrame:
    """(kind, value, n_parts): values of each kind that occur in more than one part."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.cast("string").alias("value")) for k, c in kinds.items())))
    rows = df.select(part.alias("part"), each.alias("x")).select("part", "x.*").where("part is not null and value is not null").distinct()
    return rows.groupBy("kind", "value").agg(F.count("*").alias("n_parts")).where("n_parts > 1")


def confounded(df: DataFrame, group: Column, label: Column) -> DataFrame:
    """One row: groups, groups with one label only, and whether labels are confounded with groups."""
    per = df.select(group.alias("g"), label.alias("l")).where("g is not null and l is not null").groupBy("g").agg(F.countDistinct("l").alias("labels"))
    groups, pure = F.count("*"), F.count_if(F.col("labels") == 1)
    return per.agg(groups.alias("groups"), pure.alias("pure_groups"), ((groups > 1) & (pure == groups)).alias("confounded"))


def first_in_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rank in group: 1 is the canonical row. For bounded groups."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
