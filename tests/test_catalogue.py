"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as driver
from strandmill import catalogue

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the test tables are not here")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@needs_tables
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, connection, name):
    assert compare(spark, connection, name, catalogue.QUERIES[name], catalogue.ORACLES[name], SF_DIR) == ""


@needs_tables
def test_entry(spark):
    assert driver.entry(spark).count() == 1


def test_every_query_has_sql():
    assert catalogue.QUERIES.keys() == catalogue.ORACLES.keys()
    assert catalogue.QUERIES.keys() <= driver.queries().keys() and driver.oracle_sql().keys() <= driver.queries().keys()
