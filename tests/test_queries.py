"""Every registered query against its SQL counterpart."""

import os

import pytest

import __spark_entry__ as driver
from faultlens.plans import workload
from compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(workload.QUERIES) == set(workload.ORACLE)
    assert set(workload.QUERIES) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(workload.QUERIES))
def test_query(spark, con, name):
    problem = differences(spark, con, SF_DIR, name, driver.queries()[name],
                          driver.oracle_sql()[name])
    assert problem is None, problem


def test_entry(spark):
    assert driver.entry(spark).count() > 0
