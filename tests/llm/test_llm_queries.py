"""The registered queries against SQL, where there is some."""

import pytest
from compare import expected, rows

from siltstone.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, data, name):
    assert rows(queries.QUERIES[name](spark, data)) == expected(queries.ORACLE_SQL[name], data)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
