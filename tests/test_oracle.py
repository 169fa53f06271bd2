"""Every query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import compare, duck

SF_DIR = "/root/testdata/sf0.001"
NAMES = list(entry.oracle_sql())

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    assert compare(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name]) == ""


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
