"""Every registered query runs; those with SQL agree with it."""

import pytest

from conftest import SMALL
from feldspark.plans import load_catalog
from harness import compare

CATALOG = load_catalog()


@pytest.mark.parametrize("name", sorted(CATALOG.QUERIES))
def test_query(spark, oracle, name):
    result = CATALOG.QUERIES[name](spark, SMALL)
    if name in CATALOG.ORACLES:
        assert compare(result, oracle, CATALOG.ORACLES[name]) is None
    else:
        assert result.limit(1).count() == 1
    spark.catalog.clearCache()


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
