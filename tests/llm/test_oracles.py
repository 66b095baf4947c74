import pytest

from quire.llm import queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, queries.QUERIES[name], queries.ORACLES[name], "/root/testdata/sf0.01") > 0
