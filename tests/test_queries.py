"""Every registered query with SQL gives DuckDB's rows; the others run and give rows."""

import comparing
import pytest

from crosspanel.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return comparing.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    assert comparing.differences(QUERIES[name](spark, SF), SQL[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).limit(5).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
