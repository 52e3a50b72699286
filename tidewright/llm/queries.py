"""Queries of the problems tagged llm; each takes (spark, folder) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import bpe, consensus, overlap, packing, pairs, pii, runs, splits


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.found(_read(spark, d, "belly_observations"))


def p1_consensus(spark: SparkSession, d: str) -> DataFrame:
    return consensus.discover(_read(spark, d, "belly_observations"))[0]


def p1_reliability(spark: SparkSession, d: str) -> DataFrame:
    return consensus.discover(_read(spark, d, "belly_observations"))[1]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.groups(_read(spark, d, "token_members"), _read(spark, d, "source_records"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.torn(splits.sets(_read(spark, d, "source_records")))


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign(_read(spark, d, "source_records"), _read(spark, d, "split_targets"))


def p3_balance(spark: SparkSession, d: str) -> DataFrame:
    return splits.balance(p3_splits(spark, d), _read(spark, d, "split_targets"))


def p3_labels(spark: SparkSession, d: str) -> DataFrame:
    return splits.label_balance(_read(spark, d, "source_records"), p3_splits(spark, d), _read(spark, d, "split_targets"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return runs.found(_read(spark, d, "frame_grades"))


def p4_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.runs(_read(spark, d, "frame_grades"), runs.EXACT, 1)


def p4_near_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.runs(_read(spark, d, "frame_grades"), runs.NEAR, 1)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.found(_read(spark, d, "source_records"))


def p6_by_split_and_group(spark: SparkSession, d: str) -> DataFrame:
    return overlap.by_split_and_group(_read(spark, d, "source_records"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_column(_read(spark, d, "documents"), "doc_id")


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and whether the decoded ids are the text again."""
    documents = _read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("original"))
    return bpe.decode_column(p7_ids(spark, d), "doc_id").join(documents, "doc_id").select("doc_id", (F.col("text") == F.col("original")).alias("same"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(_read(spark, d, "documents"), _read(spark, d, "token_budgets"))


def p8_summary(spark: SparkSession, d: str) -> DataFrame:
    return packing.summary(_read(spark, d, "documents"), _read(spark, d, "token_budgets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.findings(_read(spark, d, "documents"), _read(spark, d, "reviewers"))


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(_read(spark, d, "documents"), _read(spark, d, "reviewers"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_consensus, p1_reliability, p2_found, p3_found, p3_splits, p3_balance, p3_labels, p4_found, p4_runs, p4_near_runs, p6_found,
        p6_by_split_and_group, p7_ids, p7_round_trip, p8_containers, p8_summary, p9_found, p9_redacted,
    )
}
