"""Model tables of few rows: what cannot be fitted is empty or NULL, not an error."""

import dataclasses

import numpy as np
import pytest

from launchlens.plans import two_channel
from launchlens.plans.common import design_matrix

SETTINGS = dataclasses.replace(two_channel.DEFAULT, forest_trees=2)


def matrix(spark, n):
    """``n`` complete rows and two with a hole."""
    rows = [(float(i) + 1, float(i * i % 7), float(i % 3) if i < n else None, "ab"[i % 2], f"p{i}") for i in range(n + 2)]
    return design_matrix(spark.createDataFrame(rows, "y double, a double, b double, c string, id string"), "y", ["a", "b"], ["c"], ["id"])


def test_matrix_without_complete_rows(spark):
    m = matrix(spark, 0)
    assert (m.xs, m.df.columns, m.df.count()) == ([], ["y", "id_id"], 0)
    assert sorted(map(tuple, m.left_out.collect())) == [("p0", "b"), ("p1", "b")]


@pytest.mark.parametrize("n", [0, 1, 3, 6])
def test_training_on_few_rows(spark, n):
    m = matrix(spark, n)
    found = two_channel.train_all(m, SETTINGS, {"rounds": 2}, [1])
    names = {r["model"] for r in found["metrics"].collect()}
    assert names == ({"linear", "forest", "boosted", "bagged"} if m.xs else set())
    for name, schema in two_channel.RESULTS.items():
        assert found[name].columns == [c.split()[0] for c in schema.split(", ")]
        assert found[name].count() > 0 or not m.xs


def test_dealt_blocks_hold_every_row_once_and_pools_their_share(spark, monkeypatch):
    from launchlens.operators import trees

    rows = spark.createDataFrame([(float(i), i % 3, bytes([i % 7, i % 2])) for i in range(3000)], "y double, fold int, codes binary").repartition(4)
    bins = trees.Bins([np.arange(6.0), np.array([0.0])])

    def seen(limit, folds, chunks):
        monkeypatch.setattr(trees, "POOL_ROWS", limit)

        def grow(codes, y, candidate, out, chunk):
            assert len(codes) == len(y) and (codes[:, 0] == y % 7).all() and (codes[:, 1] == y % 2).all()
            assert out < 0 or (y % 3 != out).all()
            return len(y), np.zeros(1, trees._NODE), np.array([y.sum(), len(set(y.tolist()))])

        return {(r["candidate"], r["out"], r["chunk"]): (r["trees"], *r["gains"]) for r in trees._grown(rows, 3000, grow, bins, 2, chunks, folds).collect()}

    whole = seen(5000, [-1, 0, 2], 2)
    assert len(whole) == 12 and all(v[0] == v[2] == (3000 if k[1] < 0 else 2000) for k, v in whole.items())
    pools = seen(1000, [-1], 3)
    assert len(pools) == 6 and all(850 < v[0] < 1150 for v in pools.values())
    assert pools[0, -1, 0] == pools[1, -1, 0] and len({v[1] for v in pools.values()}) == 3


def test_trees_try_only_columns_that_are_drawn_and_leave_small_nodes():
    from launchlens.operators import trees

    draw = np.random.default_rng(1)
    codes = np.column_stack([draw.integers(0, 8, 400), draw.integers(0, 2, 400)]).astype(np.uint8)
    y = codes[:, 0] * 2.0 + codes[:, 1] + draw.random(400)
    weight = np.ones((1, 400), np.int64)
    starts = np.array([0, 8, 10])
    one, gains = trees._grow(codes, starts, y, weight, 2, np.array([[False, True]]), 5, 5.0, 0.0, 0.0, draw)
    assert gains[0] == 0 and len(one) == 3 and one["feature"][0] == 1
    assert one["value"][1:].tolist() == pytest.approx([y[codes[:, 1] == k].mean() for k in (0, 1)])
    best = min(((y[codes[:, 0] <= c].var() * (codes[:, 0] <= c).sum() + y[codes[:, 0] > c].var() * (codes[:, 0] > c).sum()), c) for c in range(7))
    full, _ = trees._grow(codes, starts, y, weight, 2, None, 30, 5.0, 0.0, 0.0, draw)
    assert (full["feature"][0], full["cut"][0]) == (0, best[1])
    calls = []
    inner = trees._best_cuts

    def watched(codes, bins, asked, row, node, w, wy, size, *rest):
        calls.append((len(asked), float(size[asked].min())))
        return inner(codes, bins, asked, row, node, w, wy, size, *rest)

    trees._best_cuts = watched
    try:
        trees._grow(codes, starts, y, weight, 1, None, 30, 5.0, 0.0, 0.0, draw)
    finally:
        trees._best_cuts = inner
    assert all(least >= 10 for _, least in calls)


@pytest.mark.parametrize("limit", [5000, 1000])
def test_held_out_rows_are_scored_whole_by_trees_that_did_not_see_them(spark, monkeypatch, limit):
    from launchlens.operators import trees

    rows = spark.createDataFrame([(float(i), i % 3, bytes([i % 7, i % 2])) for i in range(3000)], "y double, fold int, codes binary").repartition(4)
    bins = trees.Bins([np.arange(6.0), np.array([0.0])])
    monkeypatch.setattr(trees, "POOL_ROWS", limit)

    def grow(codes, y, candidate, out, chunk):
        assert (y % 3 != out).all() and (len(y) == 2000 if limit > 3000 else 550 < len(y) < 800)
        nodes = np.zeros(1, trees._NODE)
        nodes["left"], nodes["value"] = -1, 100 * candidate + 10 * out + chunk
        return 1, nodes, np.zeros(2)

    sums = trees._grown(rows, 3000, grow, bins, 2, 3, [0, 1, 2], scored=True)
    assert "nodes" not in sums.columns
    got = [tuple(r) for r in trees._held_out(sums, lambda fold: 1000.0 * fold, None).collect()]
    assert sorted((k, f, o) for k, f, o, _ in got) == [(k, f, float(i)) for k in (0, 1) for f in range(3) for i in range(f, 3000, 3)]
    assert all(p == pytest.approx(1000 * f + 100 * k + 10 * f + 1) for k, f, _, p in got)
