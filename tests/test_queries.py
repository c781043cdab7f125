"""Every query has a stable schema at the small scale and agrees with its SQL twin at the oracle scale."""

import pytest

from tests.conftest import ORACLE, SMALL
from tests.oracle import assert_same
from trainkit.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, name):
    assert_same(registry.QUERIES[name](spark, ORACLE), registry.ORACLES[name], ORACLE)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SMALL)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
