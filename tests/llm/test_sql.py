"""The operators that SQL can state, against DuckDB on the smallest tables."""

import pytest

from catalog.check import compare, connect
from launchlens.llm.queries import ORACLES, QUERIES

ROOT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    ok, note = compare(spark, connect(ROOT), ROOT, QUERIES[name], ORACLES[name])
    assert ok and "types differ" not in note, note
