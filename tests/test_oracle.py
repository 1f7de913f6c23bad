"""Every query with SQL gives the rows that DuckDB gives; every other one runs."""

import pytest

from quarry.plans import catalogue

from .oracle import compare, connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_sql(spark, con, name):
    compare(spark, con, name, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    assert len(df.columns) == len(set(df.columns))
    df.count()
