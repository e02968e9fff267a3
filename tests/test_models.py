import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from launchlens import operators as op

XS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 4)) * [1, 50, 0.1, 3] + [0, 100, 5, -2]
    y = 4 + 2 * x[:, 0] - 0.1 * x[:, 1] + rng.normal(size=120) * 0.5
    return x, y


@pytest.fixture(scope="module")
def df(spark, data):
    x, y = data
    rows = [(*map(float, r), float(t), i % 4) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, [*XS, "y", "fold"]).repartition(5).cache()


def ols(x, y):
    design = np.column_stack([np.ones(len(x)), x])
    return np.linalg.lstsq(design, y, rcond=None)[0]


def test_linear_against_numpy(df, data):
    x, y = data
    fit = op.fit_linear(df, "y", XS, fold="fold")
    want = ols(x, y)
    assert fit.intercept == pytest.approx(want[0])
    assert list(fit.coefs.values()) == pytest.approx(list(want[1:]))
    table = {r.term: r for r in op.linear_summary(df, fit).collect()}
    design = np.column_stack([np.ones(len(x)), x])
    residual = y - design @ want
    cov = residual @ residual / (len(y) - 5) * np.linalg.inv(design.T @ design)
    assert table["a"].std_error == pytest.approx(math.sqrt(cov[1, 1]))
    assert table["(Intercept)"].t == pytest.approx(want[0] / math.sqrt(cov[0, 0]))
    assert table["a"].p < 1e-6 < table["d"].p


def test_resampling_holds_each_fold_out(df, data):
    x, y = data
    got = {r.fold: r for r in op.fit_linear(df, "y", XS, fold="fold").resampled.collect()}
    fold = np.arange(120) % 4
    for f in range(4):
        b = ols(x[fold != f], y[fold != f])
        error = y[fold == f] - b[0] - x[fold == f] @ b[1:]
        pred = b[0] + x[fold == f] @ b[1:]
        assert got[f].rmse == pytest.approx(math.sqrt((error ** 2).mean()))
        assert got[f].mae == pytest.approx(np.abs(error).mean())
        assert got[f].r2 == pytest.approx(np.corrcoef(y[fold == f], pred)[0, 1] ** 2)


def shares(x, y, coefs):
    length = np.sqrt(((x - x.mean(0)) ** 2).sum(0))
    return np.abs(np.array(coefs) * length).sum() / np.abs(ols(x, y)[1:] * length).sum()


def test_lasso_shares(df, data):
    x, y = data
    full = op.fit_lasso(df, "y", XS, fractions=[1.0])
    assert list(full.coefs.values()) == pytest.approx(list(ols(x, y)[1:]))
    for f in (0.5, 0.1, 0.01):
        fit = op.fit_lasso(df, "y", XS, fractions=[f])
        coefs = list(fit.coefs.values())
        assert shares(x, y, coefs) == pytest.approx(f, rel=1e-5)
        # Stationary: active columns share one absolute gradient, the rest lie below it.
        length = np.sqrt(((x - x.mean(0)) ** 2).sum(0))
        z = (x - x.mean(0)) / length
        gradient = np.abs(z.T @ (y - y.mean() - (x - x.mean(0)) @ np.array(coefs)))
        active = np.abs(coefs) > 1e-12
        assert np.ptp(gradient[active]) < 1e-5 * gradient.max()
        assert (gradient[~active] <= gradient[active].max() + 1e-6).all()
    tuned = op.fit_lasso(df, "y", XS, fold="fold")
    assert tuned.tuning["fraction"] == 1.0
    assert tuned.tuning["rmse_1"] < tuned.tuning["rmse_0.1"] < tuned.tuning["rmse_0.001"]


def test_step_aic_against_brute_force(df, data):
    x, y = data
    n = len(y)

    def aic(cols):
        b = ols(x[:, cols], y)
        rss = ((y - b[0] - x[:, cols] @ b[1:]) ** 2).sum()
        return n * math.log(rss / n) + 2 * (len(cols) + 1)

    best = min((aic(list(c)), c) for k in range(5) for c in itertools.combinations(range(4), k))
    fit = op.fit_step_aic(df, "y", XS, fold="fold")
    assert [XS.index(c) for c in fit.coefs] == list(best[1])
    assert fit.tuning["aic"] == pytest.approx(best[0])
    assert list(fit.coefs.values()) == pytest.approx(list(ols(x[:, list(best[1])], y)[1:]))
    assert fit.resampled.count() == 4


def test_trees_beat_the_mean_and_repeat(df):
    mean = df.agg(F.stddev_pop("y")).first()[0]
    fits = {
        "forest": lambda: op.fit_forest(df, "y", XS, trees=15, depth=6),
        "boosted": lambda: op.fit_boosted(df, "y", XS, {"rounds": 15, "depth": 3, "step": 0.3, "gamma": 0}),
        "bagged": lambda: op.fit_bagged(df, "y", XS, trees=10, depth=6),
    }
    for name, fit in fits.items():
        one, two = (
            op.regression_metrics(fit().transform(df), "y", "prediction").first() for _ in range(2)
        )
        assert one == two, name
        assert one.rmse < 0.8 * mean, name


def test_forest_picks_a_candidate_by_mae(df):
    model = op.fit_forest(df, "y", XS, "fold", trees=10, depth=5, candidates=[1, len(XS)])
    table = {r.parameters: r.mae for r in model.tuning.collect()}
    assert list(table) == ["tried=1", f"tried={len(XS)}"] and model.chosen == {"tried": min(table, key=table.get) == "tried=1" and 1 or len(XS)}
    held = model.resampled.collect()
    assert sorted(r.fold for r in held) == sorted({r.fold for r in df.select("fold").collect()})
    assert np.mean([r.mae for r in held]) == pytest.approx(min(table.values()))


def test_held_out_predictions_do_not_see_their_fold(spark):
    """A target that is the fold's number cannot be known from outside the fold."""
    rows = spark.createDataFrame([(float(i % 4), float(i % 4), i % 4) for i in range(80)], "y double, x double, fold int")
    for fit in (op.fit_bagged(rows, "y", ["x"], "fold"), op.fit_boosted(rows, "y", ["x"], {"rounds": 30, "step": 0.3}, "fold")):
        assert fit.transform(rows).agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0] < 0.5
        assert min(r.mae for r in fit.resampled.collect()) > 0.5


def tree_by_hand(x, y, depth, min_rows):
    """A regression tree over all cuts between different values: (column, cut, left, right) or a mean."""
    best = None
    for j in range(x.shape[1]):
        for cut in sorted(set(x[:, j]))[:-1]:
            left = x[:, j] <= cut
            if min(left.sum(), (~left).sum()) >= min_rows:
                gain = y[left].sum() ** 2 / left.sum() + y[~left].sum() ** 2 / (~left).sum() - y.sum() ** 2 / len(y)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, j, cut, left)
    if depth == 0 or best is None or best[0] <= 1e-9:
        return y.mean()
    _, j, cut, left = best
    return (j, cut, tree_by_hand(x[left], y[left], depth - 1, min_rows), tree_by_hand(x[~left], y[~left], depth - 1, min_rows))


def test_one_tree_is_the_tree_by_hand(spark):
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 9, (120, 3)).astype(float), rng.normal(size=120)
    rows = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double")
    model = op.fit_boosted(rows, "y", ["a", "b", "c"], {
        "rounds": 1, "depth": 4, "step": 1.0, "gamma": 0.0, "columns": 1.0, "row_share": 1.1, "min_rows": 6, "penalty": 0.0})

    def value(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    tree = tree_by_hand(x, y - y.mean(), 4, 6)
    got = {(r.a, r.b, r.c): r.prediction for r in model.transform(rows).collect()}
    assert all(got[tuple(r)] == pytest.approx(y.mean() + value(tree, r)) for r in x)


def test_trees_skip_holes_and_say_null(frame):
    rows = frame([(float(i % 2), float(i % 2) * 3, i % 2) for i in range(40)] + [(None, 9.0, 0), (1.0, None, 1)], "x double, y double, fold int")
    model = op.fit_bagged(rows, "y", ["x"], "fold")
    assert {(r.x, r.prediction) for r in model.transform(rows).collect()} == {(0.0, 0.0), (1.0, 3.0), (None, None)}
    with pytest.raises(ValueError):
        op.fit_bagged(rows.filter("x is null"), "y", ["x"])


def test_importance_is_scaled(df):
    table = op.importance(df, op.fit_linear(df, "y", XS)).collect()
    assert table[0].importance == 100.0 and table[-1].importance == 0.0
    assert {table[0].variable, table[1].variable} == {"a", "b"}
    assert op.importance(df, op.fit_bagged(df, "y", XS, trees=5, depth=4), top=2).count() == 2


def test_metrics_use_squared_correlation(frame):
    df = frame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "obs double, pred double")
    got = op.regression_metrics(df).first()
    assert got.r2 == pytest.approx(1.0) and got.mae == pytest.approx(2.0)
    assert got.rmse == pytest.approx(math.sqrt(14 / 3))
    back = op.obs_pred(frame([(0.0, 1.0)], "o double, p double"), "o", "p", 1.0).first()
    assert (back.obs, back.pred) == (0.0, pytest.approx(math.e - 1))
