import numpy as np
import pytest

from launchlens import operators as op


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(4)
    centres = np.array([[0, 0], [10, 0], [0, 10]])
    x = np.vstack([c + rng.normal(size=(20, 2)) for c in centres] + [[[40.0, 40.0]]])
    return x, np.array([1] * 20 + [2] * 20 + [3] * 20 + [4])


@pytest.fixture(scope="module")
def df(spark, blobs):
    x, label = blobs
    return spark.createDataFrame(
        [(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, label))],
        "id int, x double, y double, cluster int").cache()


def brute(x, label):
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i, own in enumerate(label):
        mine = (label == own).sum()
        a = dist[i, label == own].sum() / (mine - 1) if mine > 1 else None
        b = min((dist[i, label == c].mean(), c) for c in set(label) if c != own)
        out.append((int(b[1]), 0.0 if a is None else (b[0] - a) / max(a, b[0])))
    return out


@pytest.mark.parametrize("block_rows", [7, 1024])
def test_silhouette_against_brute_force(df, blobs, block_rows):
    got = {r.id: (r.neighbor, r.sil_width)
           for r in op.silhouette(df, "id", ["x", "y"], block_rows=block_rows).collect()}
    for i, (neighbor, width) in enumerate(brute(*blobs)):
        assert got[i] == (neighbor, pytest.approx(width))
    assert got[60][1] == 0.0


def test_cluster_distances_count_every_pair_once(df):
    got = op.cluster_distances(df.selectExpr("id", "array(x, y) v", "cluster"), "id", "v", block_rows=10)
    assert got.agg({"n": "sum"}).first()[0] == 61 * 61
    assert got.count() == 61 * 4


def test_kmeans_finds_the_blobs_and_repeats(df, blobs):
    few = df.filter("cluster < 4")
    fit = op.kmeans_fit(few, ["x", "y"], 3, n_start=4)
    rows = op.assign_clusters(few, fit).select("id", "cluster").collect()
    got = {r.id: r.cluster for r in rows}
    assert set(got.values()) == {1, 2, 3}
    assert all(len({got[i] for i in range(s, s + 20)}) == 1 for s in (0, 20, 40))
    # Numbered by centre: the blob around (10, 0) comes last.
    assert got[20] == 3
    again = op.kmeans_fit(few.repartition(3), ["x", "y"], 3, n_start=4)
    assert {r.id: r.cluster for r in op.assign_clusters(few, again).collect()} == got


def test_elbow(df):
    scaled = op.zscore(df, ["x", "y"])
    got = {r.k: r.cost for r in op.elbow_curve(scaled, ["x", "y"], (1, 2, 4), n_start=4).collect()}
    assert got[1] == pytest.approx((61 - 1) * 2)
    assert got[1] > got[2] > got[4]
    best = min(op.kmeans_fit(scaled, ["x", "y"], 2, n_start=1, seed=s).cost for s in (1, 2, 3, 4))
    assert got[2] == pytest.approx(best)


def test_squared_silhouette_score(df):
    assert op.silhouette_score_squared(df.filter("cluster < 4"), ["x", "y"]) > 0.8


def lloyd(x, centres):
    """One fit by hand from given centres, and its cost."""
    while True:
        squared = ((x[:, None] - centres[None]) ** 2).sum(-1)
        label = squared.argmin(1)
        moved = np.array([x[label == c].mean(0) if (label == c).any() else centres[c] for c in range(len(centres))])
        if np.array_equal(moved, centres):
            return squared.min(1).sum()
        centres = moved


def test_every_run_is_a_fit_of_its_own(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(70, 3)).round(3)
    frame = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double")
    runs = op.kmeans_runs(frame.repartition(3), ["a", "b", "c"], (1, 2, 5), n_start=3)
    assert [(r.k, r.start) for r in runs] == [(1, 0), (2, 0), (2, 1), (2, 2), (5, 0), (5, 1), (5, 2)]
    for r in runs:
        assert r.cost == pytest.approx(lloyd(x, r.centres))
        assert ((x[:, None] - r.centres[None]) ** 2).sum(-1).min(1).sum() == pytest.approx(r.cost)
    alone = op.kmeans_runs(frame, ["a", "b", "c"], (5,), n_start=1, seed=3)
    assert alone[0].cost == pytest.approx(runs[-1].cost)
    assert len({round(r.cost, 6) for r in runs[-3:]}) > 1


def test_kmeans_of_few_rows_nulls_and_copies(frame):
    rows = frame([(1, 0.0, 0.0), (2, 0.0, -0.0), (3, 4.0, 1.0), (4, None, 1.0)] + [(i, 4.0, 1.0) for i in range(5, 60)], "id int, x double, y double")
    fit = op.kmeans_fit(rows, ["x", "y"], 4, n_start=3)
    assert fit.cost == 0 and fit.centres.tolist() == [[0, 0], [4, 1]]
    got = {r.id: r.cluster for r in op.assign_clusters(rows, fit).collect()}
    assert got[1] == got[2] == 1 and got[3] == got[59] == 2 and got[4] is None
    with pytest.raises(ValueError):
        op.kmeans_fit(rows.filter("id = 4"), ["x", "y"], 2)
    assert op.elbow_curve(rows.filter("id = 4"), ["x", "y"]).count() == 0


def test_limited_passes_report_the_cost_of_the_last_centres(spark):
    x = np.random.default_rng(2).normal(size=(300, 2))
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double")
    fit = op.kmeans_runs(frame, ["a", "b"], (6,), n_start=1, max_iter=2)[0]
    assert fit.passes == 2
    assert ((x[:, None] - fit.centres[None]) ** 2).sum(-1).min(1).sum() == pytest.approx(fit.cost)


def test_distances_of_a_block_do_not_depend_on_row_order(spark):
    rows = [(i, [0.1 * i * i, 10.0 ** (i % 7)], i % 2) for i in range(60)]
    schema = "id long, v array<double>, cluster int"
    found = [
        sorted(map(str, op.cluster_distances(spark.createDataFrame(some, schema).coalesce(1), "id", "v").collect()))
        for some in (rows, rows[::-1], rows[30:] + rows[:30])
    ]
    assert found[0] == found[1] == found[2]
