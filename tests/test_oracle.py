"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.cases import ORACLES
from checks.compare import difference, oracle_connection

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, connection, name):
    assert difference(spark, SF_DIR, queries()[name], oracle_sql()[name], connection) is None


def test_entry(spark):
    found = {row.type for row in entry(spark).collect()}
    assert found == {"date_format_inconsistency"}
