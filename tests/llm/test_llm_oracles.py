from pathlib import Path

import oracle
import pytest

from tidewright.llm import queries, sql

pytestmark = pytest.mark.skipif(not Path(oracle.FOLDER).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_same_as_sql(spark, name):
    oracle.check(spark, queries.QUERIES[name], sql.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(sql.ORACLES)))
def test_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, oracle.FOLDER).count() > 0
