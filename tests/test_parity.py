"""Every query with SQL equals it on the small tables; the others give rows."""

import pytest
from jobsift.plans.queries import ORACLE_SQL, QUERIES
from tests.parity import assert_same, connect

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SF), con, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
