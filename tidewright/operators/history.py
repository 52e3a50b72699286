"""Filters, paging and projections over a log of events."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.numbers import first_number


def wall_date(timestamp_text: Column) -> Column:
    """The date written in an ISO text, in the event's own zone."""
    return F.substring(timestamp_text, 1, 10).try_cast("date")


def between_days(df: DataFrame, column: str, first: date | None, last: date | None) -> DataFrame:
    """Rows of the days first to last, both included; None leaves an end open. first > last is an error."""
    if first and last and first > last:
        raise ValueError("the first day lies after the last")
    day = wall_date(F.col(column))
    if first:
        df = df.where(day >= F.lit(first))
    return df.where(day <= F.lit(last)) if last else df


def id_search(df: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose number contains the text, without the word fish, # and blanks; an empty text keeps all."""
    needle = text.lower().replace("fish", "").replace("#", "").strip()
    return df.where(F.col(column).cast("string").contains(needle)) if needle else df


def same_text(column: Column, text: str, default: str = "Ungraded") -> Column:
    """Equality without letter case; null and empty count as the default."""
    return F.lower(F.coalesce(F.nullif(column, F.lit("")), F.lit(default))) == text.lower()


def at_least(threshold: float, *candidates: Column) -> Column:
    """Whether the first candidate that is a number, in percent, reaches the threshold."""
    return F.coalesce(first_number(*candidates), F.lit(0.0)) * 100 >= threshold


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page in a total order. Only number * size rows are kept while sorting."""
    return df.orderBy(*order).limit(number * size).offset((number - 1) * size)


def page_counts(df: DataFrame, size: int) -> DataFrame:
    """(total, total_pages); an empty table has one page."""
    total = F.count("*")
    return df.agg(total.alias("total"), F.greatest(F.ceil(total / size), F.lit(1)).cast("bigint").alias("total_pages"))


def newest(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The n newest rows, n clamped to 1..1000."""
    return df.orderBy(*order).limit(min(max(n, 1), 1000))


def newest_in_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The n first rows of each group; Spark filters by rank before the exchange (group limit)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")
