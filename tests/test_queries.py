"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from queries import REGISTRY
from tools.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", [n for n in REGISTRY if n in entry.oracle_sql()])
def test_query(spark, connection, name):
    assert difference(entry.queries()[name](spark, SF_DIR), connection, entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 7
