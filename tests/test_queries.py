"""Every registered query beside its SQL."""

import pytest

import __spark_entry__ as contract
from checker import connect, differences, spark_rows
from conftest import DATA

QUERIES = contract.queries()
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, sf, name):
    assert differences(QUERIES[name](spark, sf), db, SQL[name]) == []


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_has_rows(spark, sf, name):
    assert spark_rows(QUERIES[name](spark, sf))[2]


def test_entry(spark):
    row = contract.entry(spark).first()
    assert row["n_scored"] == 500 and 0 < row["f1"] < 1
