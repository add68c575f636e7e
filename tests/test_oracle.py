"""Every registered query against its DuckDB oracle on the smallest test data."""

import os

import pytest

from check_oracle import compare, duck
from corpusgraph.plans.catalog import ORACLE_STATEMENTS, QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_oracle(spark, con, name):
    ok, note = compare(spark, con, SF_DIR, name, QUERIES[name], ORACLE_STATEMENTS.get(name))
    assert ok, note
    assert "EMPTY" not in note, note
