"""Every oracle-checked query against its DuckDB SQL at sf0.001, and the smoke entry."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle_compare import compare, duck

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, E.queries()[name], SQL[name], SF_SMALL)
    assert r["ok"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["label", "n", "pct"] and len(rows) >= 1


def test_every_query_has_a_builder():
    assert set(SQL) <= set(E.queries())
