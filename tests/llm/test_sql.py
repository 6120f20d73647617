"""The queries that SQL can express give DuckDB's rows."""

import comparing
import pytest

from crosspanel.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    assert comparing.differences(QUERIES[name](spark, SF), ORACLE_SQL[name], comparing.connect(SF)) == ""
