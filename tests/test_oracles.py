from pathlib import Path

import oracle
import pytest

from tidewright.plans import registry

pytestmark = pytest.mark.skipif(not Path(oracle.FOLDER).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_same_as_sql(spark, name):
    oracle.check(spark, registry.queries()[name], registry.oracles()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_without_sql_runs(spark, name):
    df = registry.queries()[name](spark, oracle.FOLDER)
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
