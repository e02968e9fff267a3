import random

import pytest
from pyspark.sql import types as T

from launchlens import operators as op
from launchlens.plans import common

ORDERS = [
    ("amount", -5.0, 2.0), ("amount", 1.0, 1.0), ("qty", 5.0, -2.0), ("both", -1.0, -1.0),
    ("zero", -1.0, 1.0), ("zero", 1.0, -1.0), ("mixed", -1.0, 2.0), ("mixed", 4.0, 1.0),
    ("hole", None, 1.0), (None, -9.0, -9.0),
]


@pytest.fixture
def orders(frame):
    return frame(ORDERS, "slip string, amount double, qty double")


def test_negative_groups(orders):
    got = {r.slip for r in op.negative_groups(orders, "slip", ["amount", "qty"]).collect()}
    assert got == {"amount", "qty", "both", None}


def test_drop_negative_groups_keeps_lines_without_key(orders):
    got = op.drop_negative_groups(orders, "slip", ["amount", "qty"]).collect()
    assert sorted(str(r.slip) for r in got) == ["None", "hole", "mixed", "mixed", "zero", "zero"]


def test_cleaning_audit(orders):
    got = op.cleaning_audit(orders, "slip", ["amount", "qty"]).first()
    assert (got.n_before, got.n_removed, got.n_after) == (6, 3, 3)


@pytest.mark.parametrize("seed", [1, 2])
def test_cleaning_leaves_no_negative_group(frame, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(40), rng.uniform(-5, 5), float(rng.randint(-3, 4))) for _ in range(300)]
    df = frame(rows, "slip int, amount double, qty double")
    left = op.drop_negative_groups(df, "slip", ["amount", "qty"])
    assert op.negative_groups(left, "slip", ["amount", "qty"]).count() == 0
    gone = {r.slip for r in op.negative_groups(df, "slip", ["amount", "qty"]).collect()}
    assert left.count() == sum(r[0] not in gone for r in rows)


def test_semi_joins(frame):
    skus = frame([(1,), (2,), (3,), (None,)], "sku int")
    web, pos = frame([(1,), (1,)], "sku int"), frame([(3,), (9,)], "sku int")
    assert [r.sku for r in op.keep_sold_skus(skus, web).collect()] == [1]
    assert sorted(r.sku for r in op.keep_sold_skus(skus, web, pos).collect()) == [1, 3]


def test_filters_drop_nulls(frame):
    df = frame([("a", 1.0), ("b", -1.0), (None, None)], "k string, x double")
    assert op.exclude_values(df, "k", ["a"]).count() == 1
    assert op.keep_values(df, "k", ["a", "b"]).count() == 2
    assert op.require_non_negative(df, ["x"]).count() == 1


def test_burst_rule(frame):
    rows = [(1000.0, 1000.0), (1000.0, 1001.0), (1001.0, 1001.0), (None, 1001.0), (1001.0, None)]
    df = frame(rows, "target double, early double")
    got = [(r.target, r.early) for r in op.drop_burst_only(df, "target", ["early"], 1000).collect()]
    assert got == [(1000.0, 1000.0), (1001.0, 1001.0), (1001.0, None)]


def test_conform(frame):
    df = frame([("7", "2019-01-02", "3.5", "x"), ("x", "soon", "y", "z")],
               "sku string, d string, q string, other string")
    spec = T.StructType([T.StructField("SKU", T.LongType()), T.StructField("d", T.DateType()),
                         T.StructField("q", T.DoubleType()), T.StructField("absent", T.LongType())])
    got = op.conform(df, spec)
    first, second = got.collect()
    assert (first[0], str(first.d), first.q, first.other) == (7, "2019-01-02", 3.5, "x")
    assert (second[0], second.d, second.q) == (None, None, None)


def test_clean_web_keeps_one_entry_method(frame):
    rows = [(1, "2019-01-01", "o1", "1", "21", "5", "1"), (1, "2019-01-01", "o2", "1", "20", "5", "1"),
            (1, "2019-01-01", "o3", "1", "21", "-5", "1")]
    df = frame(rows, "sku int, order_date string, order_number string, order_line_number string, "
                     "order_entry_method string, amount string, confirmed_quantity string")
    got = common.clean_web(df).collect()
    assert [r.order_number for r in got] == ["o1"]
    assert "order_entry_method" not in got[0].asDict()


def test_align_and_tag(frame):
    df = frame([(1, "a")], "sku int, k string")
    schema = T.StructType([T.StructField("store", T.LongType()), T.StructField("sku", T.LongType())])
    got = op.align_to(op.tag_channel(df, "Web"), schema)
    assert got.schema == T.StructType([T.StructField("store", T.LongType()), T.StructField("sku", T.LongType())])
    assert got.first().asDict() == {"store": None, "sku": 1}
