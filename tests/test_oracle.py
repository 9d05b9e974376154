"""Every query of the library that has SQL gives what DuckDB gives."""

from __future__ import annotations

import pytest
from compare import duck, same

from tickloom.plans import library

FOLDER = "/root/testdata/sf0.001"
SQL = library.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    same(library.queries()[name](spark, FOLDER), con, SQL[name])


def test_every_query_has_sql():
    assert set(library.queries()) == set(SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
