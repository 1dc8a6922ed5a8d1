"""Every registered query with a SQL statement must return the rows of that statement."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import differences, duck

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no sample tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, con, name):
    problem = differences(queries()[name](spark, SF_DIR), con, oracle_sql()[name])
    assert problem is None, problem


def test_entry(spark):
    assert entry(spark).count() == 6


def test_oracles_have_queries():
    assert set(oracle_sql()) <= set(queries())
