"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import pytest
from oracle import compare, duck

from simloom.catalog import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the given tables")


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, connection, name):
    assert compare(spark, connection, SF_DIR, QUERIES[name], ORACLES[name]) == ""


def test_entry_module():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
