import pytest

from postmill.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert same(spark, QUERIES[name], ORACLE_SQL[name], "/root/testdata/sf0.01") > 0
