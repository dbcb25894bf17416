"""Every registered query against its SQL on the given tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from docmill.queries import book
from oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")
QUERIES, ORACLES = book.queries(), book.oracles()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
