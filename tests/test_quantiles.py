import numpy as np
import pytest

from launchlens import operators as op

PROBS = (0.0, 0.01, 0.25, 0.5, 0.99, 1.0)


def test_squish_bounds(frame):
    df = frame([(float(v),) for v in (1, 2, 4, 8, 16)] + [(None,), (float("nan"),)], "v double")
    low, high = op.exact_quantiles(df, ["v"], (0.01, 0.99))["v"]
    assert (low, high) == (pytest.approx(1.04), pytest.approx(15.68))
    assert [r.v for r in op.winsorize(df, ["v"]).collect()][:6] == [
        pytest.approx(1.04), 2.0, 4.0, 8.0, pytest.approx(15.68), None]


@pytest.mark.parametrize("limit, bins", [(10_000, 512), (5, 7), (0, 3)])
def test_against_numpy(spark, limit, bins):
    rng = np.random.default_rng(7)
    columns = {
        "normal": rng.normal(size=600),
        "skewed": np.exp(rng.normal(size=600) * 6),
        "ties": np.where(rng.random(600) < 0.4, 0.0, rng.integers(-3, 4, 600)),
        "constant": np.full(600, 2.5),
    }
    rows = [tuple(float(columns[c][i]) for c in columns) for i in range(600)]
    df = spark.createDataFrame(rows, [*columns]).repartition(5)
    got = op.exact_quantiles(df, list(columns), PROBS, bins=bins, sort_limit=limit)
    for c, values in columns.items():
        assert got[c] == pytest.approx(list(np.quantile(values, PROBS)), rel=1e-12), c


def test_empty_and_infinite(frame):
    df = frame([(None, 1.0), (None, float("inf"))], "a double, b double")
    assert op.exact_quantiles(df, ["a"], (0.5,)) == {"a": [None]}
    with pytest.raises(ValueError):
        op.exact_quantiles(df, ["b"], (0.5,))
