"""Pairwise matches consolidated into groups (problem 2).

A pair of two different records, in either order, is linked when its last
verdict is match. Rows whose token has no value, or with an end that is missing
or in no source record, don't count. Groups come from seedtree.components.

Defined results: repeated rows count once; of verdicts recorded at the same
time the one with the greater ``pair_id`` holds, then the greater text; rows
without a time come first; a verdict that is neither match nor no_match links
nothing but does replace an earlier one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.text import squeezed, value_or_null
from tidewright.llm.seedtree import components


def token_has_value(token: str):
    """Whether the part of ``relation:value`` after the first colon is a value."""
    value = F.regexp_replace(token, r"(?s)^[^:]*:", "")
    return value_or_null(value).isNotNull()


def linked_pairs(matches: DataFrame, records: DataFrame) -> DataFrame:
    """(left, right) of every linked pair, left < right."""
    rows = (
        matches.where(token_has_value("token"))
        .where("left_record_id is not null and right_record_id is not null and left_record_id <> right_record_id")
        .select(
            F.least("left_record_id", "right_record_id").alias("left"),
            F.greatest("left_record_id", "right_record_id").alias("right"),
            F.struct("recorded_at", "pair_id", F.regexp_replace(squeezed(F.col("verdict")), r"[\s_\-]+", "_").alias("verdict")).alias("last"),
        )
    )
    last = rows.groupBy("left", "right").agg(F.max("last").alias("last")).where("last.verdict = 'match'").select("left", "right")
    ids = records.select("record_id").where("record_id is not null").distinct()
    for end in ("left", "right"):
        last = last.join(ids.withColumnRenamed("record_id", end), end, "left_semi")
    return last


def groups(matches: DataFrame, records: DataFrame) -> DataFrame:
    """(record_id, group_id) of every record in one group with another record."""
    found = components(linked_pairs(matches, records), "left", "right")
    return found.select(F.col("vertex").alias("record_id"), F.col("component").alias("group_id"))
