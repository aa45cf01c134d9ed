"""Every registered query against its SQL check, or for non-empty rows, on the smallest data."""

import os

import pytest
from compare import compare, connect

from isolens.plans import registry

registry.load()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, name):
    ok, note, _ = compare(spark, con, SF, name)
    assert ok, note


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
