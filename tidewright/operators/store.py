"""Latest-wins store on plain Parquet: versions, merges, key checks, upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The row of greatest order per key. Partial aggregation, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))).alias("row")).select(*keys, "row.*").select(*df.columns)


def merge(old: DataFrame, new: DataFrame, keys: list[str], first_write_wins: tuple[str, ...] = ()) -> DataFrame:
    """Old rows with the members that new rows supply; null supplies nothing.

    Columns in ``first_write_wins`` keep a value they have. New keys are added.
    """
    joined = old.alias("o").join(new.alias("n"), keys, "full_outer")
    columns = []
    for c in old.columns:
        if c in keys:
            columns.append(F.col(c))
        elif c not in new.columns:
            columns.append(F.col(f"o.{c}"))
        else:
            pair = (F.col(f"o.{c}"), F.col(f"n.{c}")) if c in first_write_wins else (F.col(f"n.{c}"), F.col(f"o.{c}"))
            columns.append(F.coalesce(*pair).alias(c))
    return joined.select(*columns)


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of child whose key is in no row of parent."""
    return child.join(parent.select(*keys).distinct(), keys, "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def compare(left: DataFrame, right: DataFrame, keys: list[str], values: list[str] | None = None) -> DataFrame:
    """Each key once with its status: left_only, right_only, same or different (in the compared values)."""
    values = values or []
    a = left.select(*keys, F.struct(F.lit(1).alias("x"), *values).alias("a"))
    b = right.select(*keys, F.struct(F.lit(1).alias("x"), *values).alias("b"))
    status = F.when(F.col("b").isNull(), "left_only").when(F.col("a").isNull(), "right_only").when(F.col("a") == F.col("b"), "same").otherwise("different")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))


#: Snapshots that are kept: the current one and those that readers may still hold.
KEPT = 3


def upsert(df: DataFrame, path: str, keys: list[str], *order: Column) -> str:
    """Write the latest rows of the table at ``path`` and ``df`` as a new snapshot; returns its folder.

    Snapshots are numbered. One becomes visible by renaming its finished folder
    to the next number, so a reader sees whole snapshots only, a crash leaves
    the last one in place, and of two writers of one number the second fails.
    Superseded snapshots but the last KEPT are deleted.
    """
    spark = df.sparkSession
    numbers = _snapshots(spark, path)
    current = spark.read.parquet(_folder(path, numbers[-1])) if numbers else None
    merged = latest(df if current is None else current.unionByName(df), keys, *order)
    fs, p = _file_system(spark, path)
    draft, target = f"{path}/.draft-{uuid.uuid4().hex}", _folder(path, numbers[-1] + 1 if numbers else 0)
    merged.write.parquet(draft)
    if fs.exists(p(target)) or not fs.rename(p(draft), p(target)):
        fs.delete(p(draft), True)
        raise RuntimeError(f"another writer made {target}")
    for old in numbers[: max(0, len(numbers) + 1 - KEPT)]:
        fs.delete(p(_folder(path, old)), True)
    return target


def read_current(spark, path: str) -> DataFrame | None:
    """The newest snapshot, or None where there is none."""
    numbers = _snapshots(spark, path)
    return spark.read.parquet(_folder(path, numbers[-1])) if numbers else None


def _folder(path: str, number: int) -> str:
    return f"{path}/snapshot-{number:012d}"


def _snapshots(spark, path: str) -> list[int]:
    fs, p = _file_system(spark, path)
    if not fs.exists(p(path)):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(p(path)))
    return sorted(int(n.removeprefix("snapshot-")) for n in names if n.startswith("snapshot-"))


def _file_system(spark, path: str):
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path
