"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    good, note = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert good, note


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "total_chunks" in df.columns
