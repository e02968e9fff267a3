"""The list of top patterns and the rows kept by it come from days that are rolled up once."""

import __spark_entry__ as contract


def test_restricted_days_do_not_scan_the_lines_again(spark):
    out = contract.queries()["j6_restrict_to"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" not in plan
    assert out.select("pattern").distinct().count() == 20
