"""Sequence operators: running totals, sessions, crossings, evidence windows, folds.

Windows partition by a key. For keys that may hold a large share of all rows
there is running_number, whose tasks are bounded by a bucket of the order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_number(df: DataFrame, bucket: Column, order: list[Column], name: str = "running") -> DataFrame:
    """Number of rows up to and with each row in the whole table's order.

    ``bucket`` rises with the order. Buckets are counted first, their offsets
    come from a window over buckets only, and rows are ordered within a bucket.
    """
    rows = df.withColumn("__b", bucket)
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("__b").agg(F.count("*").alias("__n")).select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy(*order))
    return rows.withColumn("__i", inside).join(offsets, "__b").withColumn(name, F.col("__o") + F.col("__i")).drop("__b", "__i", "__o")


def with_sessions(df: DataFrame, keys: list[str], at: str, timeout: Column, tie: str) -> DataFrame:
    """Adds ``session``: a gap of more than ``timeout`` (in the unit of at's difference) starts a new one."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    new = F.coalesce((F.col(at).cast("double") - F.lag(at).over(w).cast("double") > timeout).cast("int"), F.lit(1))
    return df.withColumn("session", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def first_crossings(df: DataFrame, keys: list[str], at: str, tie: str, value: str, line: float) -> DataFrame:
    """The first row per key whose predecessor is below the line and which is not."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    crossing = (F.lag(value).over(w) < line) & (F.col(value) >= line)
    crossed = df.withColumn("__x", crossing).where("__x")
    return crossed.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(at, tie)).alias("r")).select(*keys, "r.*")


def with_segments(df: DataFrame, keys: list[str], order: list[str], resets: Column) -> DataFrame:
    """Adds ``segment``: the number of resets up to and with the row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("segment", F.sum(F.when(resets, 1).otherwise(0)).over(w))


def trailing_mean(df: DataFrame, keys: list[str], order: list[str], value: Column, usable: Column, n: int, name: str) -> DataFrame:
    """Mean of the usable rows among the last n rows of the key, unusable ones counted."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - n, 0)
    return df.withColumn(name, F.avg(F.when(usable, value)).over(w))


def smoothed(values: Column, keep: float) -> Column:
    """Exponential smoothing of an ordered array, seeded by its first value: keep * old + (1 - keep) * new."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda acc, x: F.when(acc.isNull(), x).otherwise(acc * keep + x * (1 - keep)))


def decayed_maximum(values: Column, decay: float) -> Column:
    """max(previous * (1 - decay), value) along an ordered array."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: F.greatest(acc * (1 - decay), x))


def gated(frames: Column, step: int) -> Column:
    """Of ordered numbers those that are at least ``step`` after the last one kept."""
    empty = F.array().cast("array<bigint>")
    return F.aggregate(frames, empty, lambda kept, f: F.when((F.size(kept) == 0) | (f - F.element_at(kept, -1) >= step), F.concat(kept, F.array(f))).otherwise(kept))


def gate(df: DataFrame, keys: list[str], number: str, step: int, key_schema: str) -> DataFrame:
    """Per key its distinct numbers and how many of them are kept when each must be ``step`` after the last one kept.

    The rows of a key pass through one task in order, batch by batch; only the
    last kept number is remembered. Rows without a number are left out.
    """
    rows = df.where(F.col(number).isNotNull()).select(*keys, F.col(number).cast("bigint").alias("__n")).distinct()
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "__n")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last, seen, kept = None, 0, 0, 0
        for batch in batches:
            done = []
            for *k, n in batch.itertuples(index=False, name=None):
                k = [None if pd.isna(v) else v for v in k]
                if k != key:
                    if key is not None:
                        done.append((*key, seen, kept))
                    key, last, seen, kept = k, None, 0, 0
                seen += 1
                if last is None or n - last >= step:
                    last, kept = n, kept + 1
            yield pd.DataFrame(done, columns=[*keys, "seen", "kept"])
        if key is not None:
            yield pd.DataFrame([(*key, seen, kept)], columns=[*keys, "seen", "kept"])

    return ordered.mapInPandas(scan, f"{key_schema}, seen bigint, kept bigint")
