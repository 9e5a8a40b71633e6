"""Every query against its DuckDB oracle; no answer is empty."""

import pytest
from tidemill import registry

from .duck import compare


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    assert compare(spark, "/root/testdata/sf0.01", registry.QUERIES[name], registry.ORACLES[name])


def test_queries_without_oracle_give_rows(spark, sf):
    for name in set(registry.QUERIES) - set(registry.ORACLES):
        assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
