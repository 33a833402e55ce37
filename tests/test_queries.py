"""Every registered query against its SQL twin, at the smallest scale."""

import os

import pytest
from compare import connect, differences

import __spark_entry__ as entry
from chronopanel.plans import catalog, oracle

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = catalog.QUERIES, oracle.build()

pytestmark = pytest.mark.skipif(not os.path.exists(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_sql_has_a_query():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert differences(QUERIES[name](spark, FOLDER), con, SQL[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["housing_row_accounting", "housing_name_lookup_accounting", "housing_unmatched_names"])
def test_row_accounting_moves_no_sums(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "count(1)" in plan and "sum(" not in plan
