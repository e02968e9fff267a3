import math

import numpy as np
import pytest

from launchlens import operators as op
from launchlens.operators.gram import GrowingFactor, LassoPath, Swept, student_p


def centred(rng, n, p, kind):
    x = rng.normal(size=(n, p))
    if kind == "dependent" and p > 3:
        x[:, 2] = x[:, 0] + 0.3 * x[:, 1]
    if kind == "ties":
        x = np.round(x)
    x -= x.mean(0)
    length = np.sqrt((x ** 2).sum(0))
    return x / np.where(length > 0, length, 1.0)


@pytest.mark.parametrize("kind", ["plain", "dependent", "ties"])
def test_path_is_stationary_at_every_share(kind):
    rng = np.random.default_rng(5)
    for _ in range(40):
        p = int(rng.integers(1, 12))
        x = centred(rng, 40, p, kind)
        y = x @ rng.normal(size=p) + 0.3 * rng.normal(size=40)
        y -= y.mean()
        path = LassoPath.trace(x.T @ x, x.T @ y)
        assert (np.diff(path.norms) >= -1e-12).all() and (np.diff(path.penalties) <= 1e-12).all()
        for share in (0.001, 0.1, 0.5, 0.9, 1.0):
            b = path.at_share(share)
            assert np.abs(b).sum() == pytest.approx(share * path.norms[-1])
            pull = x.T @ (y - x @ b)
            used = np.abs(b) > 1e-11
            assert np.allclose(pull[used], np.sign(b[used]) * np.abs(pull).max(), atol=1e-8)
        assert np.allclose(x @ path.slopes[-1], x @ np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-8)


def test_path_with_equal_and_empty_columns():
    equal = LassoPath.trace(np.eye(2), np.array([1.0, -1.0]))
    assert equal.at_share(0.5).tolist() == [0.5, -0.5]
    twins = LassoPath.trace(np.array([[1.0, 1.0], [1.0, 1.0]]), np.array([2.0, 2.0]))
    assert twins.slopes[-1].tolist() == [2.0, 0.0]
    none = LassoPath.trace(np.zeros((2, 2)), np.zeros(2))
    assert none.at_share(0.3).tolist() == [0.0, 0.0]


def test_sweeps_against_solves():
    rng = np.random.default_rng(6)
    x = centred(rng, 60, 7, "dependent")
    y = x @ rng.normal(size=7) + rng.normal(size=60)
    y -= y.mean()
    swept = Swept(x.T @ x, x.T @ y, y @ y)
    assert swept.cols == [0, 1, 3, 4, 5, 6]

    def rest(cols):
        return ((y - x[:, cols] @ np.linalg.lstsq(x[:, cols], y, rcond=None)[0]) ** 2).sum()

    while len(swept.cols) > 1:
        assert swept.rest == pytest.approx(rest(swept.cols))
        without = [rest([c for c in swept.cols if c != drop]) for drop in swept.cols]
        assert swept.rest_without() == pytest.approx(np.array(without))
        at = x[:, swept.cols]
        assert swept.inverse == pytest.approx(np.linalg.inv(at.T @ at))
        swept.drop(swept.cols[1])


def test_elimination_of_many_columns_ends_soon(spark):
    rng = np.random.default_rng(7)
    x = centred(rng, 900, 500, "plain")
    swept = Swept(x.T @ x, x.T @ x[:, 0], 1.0)
    for _ in range(490):
        swept.drop(swept.cols[-1])
    assert swept.slopes[0] == pytest.approx(1.0) and swept.rest == pytest.approx(0.0, abs=1e-9)


def test_factor_grows_and_shrinks():
    rng = np.random.default_rng(8)
    x = centred(rng, 50, 8, "dependent")
    gram = x.T @ x
    factor = GrowingFactor(8)
    assert [factor.add(gram, j) for j in range(8)] == [True, True, False, True, True, True, True, True]
    for col in (3, 0, 7):
        factor.drop(col)
        at = gram[np.ix_(factor.cols, factor.cols)]
        assert factor.factor @ factor.factor.T == pytest.approx(at)
        assert factor.solve(np.arange(len(at))) == pytest.approx(np.linalg.solve(at, np.arange(len(at))))


def test_p_values():
    # One and two degrees of freedom have closed forms; many come near the normal distribution.
    for t in (0.0, 0.3, 1.0, 5.0, 400.0):
        assert student_p(t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(t), abs=1e-12)
        assert student_p(-t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-12)
        assert student_p(t, 1e9) == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-6, abs=1e-300)
    assert math.isnan(student_p(math.nan, 3)) and student_p(math.inf, 3) == 0.0


def test_summary_equals_the_library_estimator(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 3)) * [1, 30, 0.2] + [5, -100, 2]
    y = 2 * x[:, 0] - 0.05 * x[:, 1] + rng.normal(size=80)
    rows = [(*map(float, r), float(t), i % 4) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, ["a", "b", "c", "y", "fold"]).repartition(3)
    fit = op.fit_linear(df, "y", ["a", "b", "c"], "fold")

    def want(rows):
        vectors = VectorAssembler(inputCols=["a", "b", "c"], outputCol="x").transform(rows)
        s = LinearRegression(featuresCol="x", labelCol="y", solver="normal").fit(vectors).summary
        return s.coefficientStandardErrors, s.tValues, s.pValues

    def near(got, rows):
        for name, column in zip(("std_error", "t", "p"), want(rows), strict=True):
            assert [r[name] for r in got] == pytest.approx(list(column), rel=1e-7, abs=1e-12)

    near(op.linear_summary(df, fit).collect(), df)
    table = op.fold_summary(df, fit).collect()
    assert len(table) == 16 and {r.n for r in table} == {60}
    for f in range(4):
        near([r for r in table if r.fold == f], df.filter(f"fold <> {f}"))


def test_rows_with_holes_and_dependent_columns(frame):
    rows = [(1.0, 2.0, 3.0), (2.0, 4.0, 5.5), (3.0, 6.0, 6.5), (None, 1.0, 1.0), (4.0, 8.0, 9.0), (5.0, 10.0, None)]
    df = frame(rows, "a double, twice double, y double")
    fit = op.fit_linear(df, "y", ["a", "twice"])
    table = {r.term: r for r in op.linear_summary(df, fit).collect()}
    assert fit.summary.n == 4 and fit.summary.df == 2
    assert fit.coefs["a"] == pytest.approx(1.9) and fit.coefs["twice"] == 0.0
    assert table["twice"].estimate is None and table["twice"].p is None
    predicted = [r.prediction for r in fit.predict(df.filter("twice = 1 or twice = 10").orderBy("twice"))
                 .select("prediction").collect()]
    assert predicted[0] is None and predicted[1] == pytest.approx(fit.intercept + 9.5)


def test_knots_as_a_table(frame):
    rows = [(float(i), float(i % 3), 2.0 * i + (i % 3)) for i in range(12)]
    df = frame(rows, "a double, b double, y double")
    table = op.lasso_path(df, "y", ["a", "b"]).collect()
    steps = max(r.step for r in table)
    ends = {r.term: r for r in table if r.step == steps}
    assert ends["a"].share == 1.0 and ends["a"].estimate == pytest.approx(2.0) and ends["b"].estimate == pytest.approx(1.0)
    starts = {r.term: r.estimate for r in table if r.step == 0}
    assert starts["a"] == starts["b"] == 0.0 and starts["(Intercept)"] == pytest.approx(12.0)
    middle = op.fit_lasso(df, "y", ["a", "b"], fractions=[[r.share for r in table if r.step == 1][0]])
    assert middle.coefs["a"] == pytest.approx([r.estimate for r in table if r.step == 1 and r.term == "a"][0])
