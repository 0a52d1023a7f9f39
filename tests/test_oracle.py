"""Every registered query against its DuckDB result on the small tables."""

import pytest

import __spark_entry__ as entry
from bindings.check import compare, oracle_connection

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("key", sorted(entry.queries()))
def test_query(spark, con, key):
    got = entry.queries()[key](spark, FOLDER).toArrow()
    sql = entry.oracle_sql().get(key)
    if sql is None:
        assert got.num_rows > 0
    else:
        assert compare(got, con.execute(sql).to_arrow_table()) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracle_keys_are_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
