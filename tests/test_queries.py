"""Every registered query of the library against its SQL."""

import pytest
from compare import expected, rows

from siltstone.plans import catalog, load

load()


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, data, name):
    assert rows(catalog.QUERIES[name](spark, data)) == expected(catalog.ORACLE_SQL[name], data)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
