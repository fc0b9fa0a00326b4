"""Every registered query runs, and agrees with its SQL where it has one."""

from __future__ import annotations

import oracle
import pytest

import __spark_entry__ as contract

QUERIES = contract.queries()
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def connection(sf_dir):
    return oracle.connect(sf_dir)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, connection, name):
    actual = oracle.spark_result(QUERIES[name](spark, sf_dir))
    if name in SQL:
        problem = oracle.compare(actual, oracle.sql_result(connection, SQL[name]))
        assert problem is None, problem
    else:
        assert actual[1]


def test_entry(spark):
    (row,) = contract.entry(spark).collect()
    assert row.test_rows > row.clean_rows > 0
    assert row.unseen_users > 0 and row.unseen_items > 0
