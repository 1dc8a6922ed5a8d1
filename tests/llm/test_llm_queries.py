"""The queries that have SQL, over the sample tables."""

import os

import pytest

from compare import differences, duck
from tableprofile.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no sample tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    problem = differences(QUERIES[name](spark, SF_DIR), duck(SF_DIR), ORACLES[name])
    assert problem is None, problem
