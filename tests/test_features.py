import numpy as np
import pytest

from launchlens import operators as op


def test_zscore_of_a_constant_is_zero(frame):
    df = frame([(1.0, 5.0, None), (2.0, 5.0, 1.0), (3.0, 5.0, 2.0)], "a double, b double, c double")
    got = op.zscore(df, ["a", "b", "c"]).collect()
    assert [r.a for r in got] == [-1.0, 0.0, 1.0]
    assert [r.b for r in got] == [0.0, 0.0, 0.0]
    assert got[0].c is None


def test_one_hot_keeps_all_levels(frame):
    df = frame([(1, "a b"), (2, "c"), (3, None)], "id int, k string")
    coded, names = op.one_hot(df, ["k"])
    assert names == ["k_a_b", "k_c"]
    assert [tuple(r) for r in coded.orderBy("id").collect()] == [(1, 1, 0), (2, 0, 1), (3, 0, 0)]


def test_one_hot_refuses_too_many_levels(frame):
    df = frame([(str(i),) for i in range(20)], "k string")
    with pytest.raises(ValueError, match="more than 5 levels"):
        op.one_hot(df, ["k"], max_levels=5)


def test_one_hot_refuses_colliding_names(frame):
    with pytest.raises(ValueError, match="share"):
        op.one_hot(frame([("a b",), ("a-b",)], "k string"), ["k"])


def test_linear_combos_against_rank(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 3)) * [1, 1000, 0.01] + [5, -300, 2]
    dummies = np.eye(3)[rng.integers(0, 3, 80)]
    data = np.column_stack([x, x[:, 0] + x[:, 1], np.full(80, 7.0), dummies])
    cols = ["x1", "x2", "x3", "sum", "const", "d1", "d2", "d3"]
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], cols).repartition(4)
    assert op.linear_combos(df, cols) == ["sum", "const", "d3"]
    kept = op.drop_linear_combos(df, cols).columns
    full = np.column_stack([np.ones(80), data])
    assert np.linalg.matrix_rank(full) == len(kept) + 1
    # Nothing to drop leaves the frame as it is.
    assert op.drop_linear_combos(df.select("x1", "x2"), ["x1", "x2"]).columns == ["x1", "x2"]


def test_near_zero_var(frame):
    rows = [(1.0, float(i % 2), float(i), 0.0 if i else 5.0) for i in range(40)]
    df = frame(rows, "const double, even double, unique double, rare double")
    got = {r.column: r for r in op.near_zero_var(df, df.columns).collect()}
    assert got["const"].zero_var and got["const"].freq_ratio == 0.0
    assert got["even"].freq_ratio == 1.0 and not got["even"].nzv
    assert got["unique"].percent_unique == 100.0
    assert got["rare"].freq_ratio == 39.0 and got["rare"].nzv and not got["rare"].zero_var
    assert op.drop_zero_var(df, df.columns).columns == ["even", "unique", "rare"]


def test_correlation_filter(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=200), rng.normal(size=200)
    data = np.column_stack([a, a + 0.01 * rng.normal(size=200), b, a + b])
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], ["a", "a2", "b", "ab"])
    dropped = op.correlation_filter(df, ["a", "a2", "b", "ab"], 0.85)
    assert len(dropped) == 1 and dropped[0] in ("a", "a2")
    m = np.abs(np.corrcoef(data[:, [i for i, c in enumerate(["a", "a2", "b", "ab"]) if c not in dropped]].T))
    assert (m[np.triu_indices(3, 1)] <= 0.85).all()


def test_profiles(frame):
    df = frame([(1.0, "a"), (2.0, None), (10.0, "a")], "x double, k string")
    assert {r.column: r.n_null for r in op.null_profile(df).collect()} == {"x": 0, "k": 1}
    assert {r.k: r.n for r in op.value_counts(df, "k").collect()} == {"a": 2, None: 1}
    assert sum(r.n for r in op.histogram(df, "x", 4).collect()) == 3
    assert [tuple(r) for r in op.histogram(frame([(3.0,), (3.0,)], "x double"), "x").collect()] == [(0, 2)]
    x = np.array([1.0, 2.0, 10.0])
    d = x - x.mean()
    skew = (d ** 3).mean() / (d ** 2).mean() ** 1.5
    assert op.skewness_profile(df, ["x"]).first().skewness == pytest.approx(skew)
