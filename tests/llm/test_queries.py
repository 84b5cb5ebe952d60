"""Every query of the subpackage that has SQL gives the rows of its SQL."""

import pytest

from caseloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(name, spark, tiny, oracle, same):
    same(queries.QUERIES[name](spark, tiny), oracle, queries.SQL[name])
