"""Every registered query against its SQL, at the smallest scale."""

from __future__ import annotations

import pytest
from check import compare, duck

import __spark_entry__ as E
from maskframe.plans.queries import registered

ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(registered()))
def test_query(spark, con, sf, name):
    query = E.queries()[name]
    if name in ORACLE:
        assert compare(spark, con, sf, query, ORACLE[name]) == ""
    else:
        assert query(spark, sf).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(E.queries())
    assert set(registered()) <= set(ORACLE)
    assert set(registered()) <= set(E.queries())


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns[0] == "c_custkey"
