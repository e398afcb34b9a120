"""Every query with SQL gives the same rows as DuckDB; the others run and return rows."""

import oracle
import pytest

from tidemark.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, con, name):
    assert oracle.differences(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], SF) == []


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    assert catalog.flagship(spark, "/root/testdata/sf0.001").count() > 0
