"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.plans import dashboard, detection, evaluation, lineage, nested, relational, sequences, streams

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [dashboard, nested, relational, sequences, evaluation, lineage, streams, detection]


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
