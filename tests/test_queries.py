"""Every registered query with SQL, against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as contract
from catalog import ORACLES, QUERIES
from catalog.check import compare, connect

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(ROOT)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    ok, note = compare(spark, con, ROOT, QUERIES[name], ORACLES[name])
    assert ok, note
    assert "types differ" not in note, note


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_returns_rows(spark):
    out = contract.entry(spark)
    assert out.columns[0] == "pattern" and out.count() > 0


@pytest.mark.parametrize("name", ["c5_cluster_patterns", "c6_cluster_patterns_by_district", "m16_fit_step_aic"])
def test_queries_without_sql_repeat(spark, name):
    query = contract.queries()[name]
    first = sorted(map(str, query(spark, ROOT).collect()))
    assert first and first == sorted(map(str, query(spark, ROOT).collect()))
