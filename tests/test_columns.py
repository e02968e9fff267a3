import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from launchlens import functions as fn

D = dt.date


def values(df, col):
    return [r[0] for r in df.select(col).collect()]


def test_effective_launch(frame):
    df = frame([
        (1, None, D(2018, 5, 1)), (2, D(2018, 4, 1), D(2018, 5, 1)),
        (3, D(2018, 5, 1), D(2018, 5, 1)), (4, D(2018, 6, 1), D(2018, 5, 1)),
    ], "sku int, master date, first_sale date")
    got = values(df, fn.effective_launch("master", "first_sale"))
    assert got == [D(2018, 5, 1), D(2018, 4, 1), D(2018, 5, 1), D(2018, 5, 1)]


AGES = [-1, 0, 6, 7, 13, 14, 20, 21, 27, 28, 59, 60, 89, 90, 119, 120, 149, 150, 179, 180, 5000, None]
WEEK3 = [None, "1W", "1W", "2W", "2W", "3W", "3W", "2M", "2M", "2M", "2M", "3M", "3M", "4M", "4M",
         "5M", "5M", "6M", "6M", ">6M", ">6M", None]
WEEK4 = [None, "1W", "1W", "2W", "2W", "3W", "3W", "4W", "4W", "2M", "2M", "3M", "3M", "4M", "4M",
         "5M", "5M", "6M", "6M", ">6M", ">6M", None]


@pytest.mark.parametrize("scheme, want", [(fn.SCHEME_WEEK3, WEEK3), (fn.SCHEME_WEEK4, WEEK4)])
def test_age_bucket(frame, scheme, want):
    df = frame([(a,) for a in AGES], "age int")
    assert values(df, fn.age_bucket("age", scheme)) == want


def test_discount_flags(frame):
    df = frame([(None, None, 1.0), (0.0, 0.0, 0.0), (2.0, 1.0, -1.0), (-2.0, -1.0, 3.0), (1.0, 1.0, None)],
               "web double, a double, b double")
    assert values(df, fn.web_discount_flag("web")) == [0, 0, 1, 1, 1]
    assert values(df, fn.pos_discount_flag("a", "b")) == [0, 0, 0, 1, 0]


def test_season_and_labels(frame):
    df = frame([("F17",), ("s18",), ("M19",), ("W17",), ("X20",), (None,)], "code string")
    assert values(df, fn.season_of("code")) == ["Fall", "Spring", "Summer", "Winter", None, None]
    family = frame([("Solid",), ("Floral",), (None,)], "f string")
    assert values(family, fn.solid_flag("f")) == ["Solid", "Non-Solid", "Non-Solid"]
    assert values(family, fn.recode("f", {"Floral": "Flower"})) == ["Solid", "Flower", None]


def test_dates(frame):
    df = frame([("2019-07-07",), ("07/07/2019",), (None,)], "d string")
    assert values(df, fn.to_date_col("d")) == [D(2019, 7, 7), None, None]
    days = frame([(17288,), (None,)], "n int")
    assert values(days, fn.epoch_days_to_date("n")) == [D(2017, 5, 2), None]
    assert values(days, fn.date_to_epoch_days(fn.epoch_days_to_date("n"))) == [17288, None]
    assert values(df, fn.month_name(fn.to_date_col("d"))) == ["July", None, None]


def test_ratios(frame):
    df = frame([("a", 1.0, 0.0), ("a", 2.0, 0.0), ("b", 3.0, 2.0), ("c", None, 4.0), ("d", 1.0, None)],
               "k string, n double, d double")
    got = {r.k: r.v for r in df.groupBy("k").agg(fn.ratio_of_sums("n", "d").alias("v")).collect()}
    assert got == {"a": None, "b": 1.5, "c": None, "d": None}
    assert values(df, fn.relative_price("n", "d")) == [1.0, 1.0, 1.5, None, None]
    assert values(df, fn.weighted_mean([("d", "n"), ("d", F.lit(1.0))])) == [None, None, 2.0, None, None]


def test_exact_sum_is_order_free(frame):
    rows = [(0.1,)] * 10 + [(1e9,), (-1e9,), (None,)]
    for order in (rows, rows[::-1]):
        assert values(frame(order, "x double").agg(fn.exact_sum("x").alias("s")), "s") == [1.0]
    assert values(frame([(None,)], "x double").agg(fn.exact_sum("x").alias("s")), "s") == [None]


def test_logs_and_clamp(frame):
    df = frame([(0.0,), (-2.0,), (math.e - 1,), (None,)], "x double")
    assert values(df, fn.log_offset("x", 1)) == [0.0, None, pytest.approx(1.0), None]
    assert values(df, fn.back_transform("x", 1))[0] == 0.0
    assert values(df, fn.clamp("x", -1, 1)) == [0.0, -1.0, 1.0, None]


def test_exact_sum_keeps_small_and_large_values(spark):
    from launchlens.functions import exact_sum

    small = spark.createDataFrame([(0.00004,)] * 1000, "x double")
    assert small.agg(exact_sum("x").alias("s")).first()["s"] == 0.04
    large = spark.createDataFrame([(4e14,), (6e14,), (1e15,)], "x double")
    assert large.agg(exact_sum("x").alias("s")).first()["s"] == 2e15


def test_dates_with_times_and_short_parts(spark):
    from datetime import date

    from launchlens.functions import to_date_col

    rows = spark.createDataFrame([("2019-01-01 00:00:00",), ("2019-1-1",), (" 2019-01-01",), ("x2019-01-01",), (None,)], "d string")
    got = [r["d"] for r in rows.select(to_date_col("d").alias("d")).collect()]
    assert got == [date(2019, 1, 1)] * 3 + [None, None]


def test_exact_sum_of_odd_values(frame):
    def total(*xs):
        return {frame([(x,) for x in order], "x double").agg(fn.exact_sum("x").alias("s")).first()["s"] for order in (xs, xs[::-1])}

    nan, inf = float("nan"), float("inf")
    assert all(x != x for x in total(nan, 1.0) | total(nan, inf))
    assert total(inf, 1.0) == {inf} and total(-inf, 1.0) == {-inf}
    assert total(-0.1, -0.2, -0.7) == {-1.0} and total(-1.5, 0.25) == {-1.25}
    assert total(1e18, 0.1, -1e18) == {0.1} and total(5e18, 5e18) == {1e19} and total(1e30, 1.0) == {1e30}
    assert total(None, None) == {None} and total(None, 2.5) == {2.5}
