import pytest
from pyspark.errors import AnalysisException

from launchlens import sources as src


def test_jdbc_options():
    plain = src.jdbc_options("jdbc:mariadb://host/db", "SKUs")
    assert plain["dbtable"] == "SKUs" and "partitionColumn" not in plain
    sliced = src.jdbc_options("u", "t", "sku", (0, 900), 30, extra={"user": "me"})
    assert (sliced["partitionColumn"], sliced["lowerBound"], sliced["upperBound"], sliced["numPartitions"]) == (
        "sku", "0", "900", "30")
    assert sliced["user"] == "me"
    with pytest.raises(ValueError):
        src.jdbc_options("u", "t", "sku")


def test_csv_round_trip(spark, tmp_path, frame):
    path = str(tmp_path / "top")
    src.save_csv(frame([("red ring",), ("a,b",)], "pattern string"), path)
    got = src.load_csv(spark, path, src.TOP_PATTERNS)
    assert got.schema == src.TOP_PATTERNS
    assert sorted(r.pattern for r in got.collect()) == ["a,b", "red ring"]


def test_save_table_fails_if_it_exists_unless_told(spark, tmp_path, frame):
    path = str(tmp_path / "t.parquet")
    src.save_table(frame([(1,)], "x int"), path)
    with pytest.raises(AnalysisException):
        src.save_table(frame([(2,)], "x int"), path)
    src.save_table(frame([(3,)], "x int"), path, mode="overwrite")
    assert [r.x for r in src.load_table(spark, "t", str(tmp_path)).collect()] == [3]


def test_catalog_table_with_buckets(spark, frame):
    src.save_table(frame([(1, "a"), (2, "b")], "sku int, k string"), "bucketed", "overwrite", bucket_by=(4, ["sku"]))
    assert src.load_table(spark, "bucketed", columns=["sku"]).columns == ["sku"]
    listed = {r["name"] for r in src.list_tables(spark).collect()}
    assert "bucketed" in listed
    plan = spark.table("bucketed").groupBy("sku").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    spark.sql("drop table bucketed")


def test_buckets_need_a_catalog_table(frame, tmp_path):
    with pytest.raises(ValueError):
        src.save_table(frame([(1,)], "x int"), str(tmp_path / "x"), bucket_by=(2, ["x"]))


def test_projection_reaches_the_scan(spark):
    df = src.load_table(spark, "lineitem", "/root/testdata/sf0.001", ["l_orderkey"]).filter("l_orderkey > 5")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint>" in plan and "GreaterThan(l_orderkey,5)" in plan
