"""Every query with SQL returns what DuckDB returns; the others are held against what defines them."""

import pytest
from oracle import assert_same

from resistrum.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    assert_same(registry.QUERIES[name](spark, sf), registry.ORACLE_SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_has_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["location", "agent", "tested", "r", "i", "s", "pct_r", "pct_i", "pct_s"]
    assert set(e.oracle_sql()) <= set(e.queries())
