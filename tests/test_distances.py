"""Distances by cluster: rows are stored once and blocks meet as they are read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from launchlens import operators as op


@pytest.mark.parametrize("kind, id_of", [("array<float>", int), ("array<double>", str)])
def test_sums_over_many_blocks_without_copies_of_rows(spark, kind, id_of):
    rng = np.random.default_rng(4)
    x, label = rng.normal(size=(300, 5)).astype(np.float32).astype(float), rng.integers(0, 4, 300)
    rows = [(id_of(i), v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label))]
    rows += [(None, [0.0] * 5, 1), (id_of(900), None, 1), (id_of(901), [0.0] * 5, None)]
    df = spark.createDataFrame(rows, f"id {'long' if id_of is int else 'string'}, v {kind}, cluster int")
    found = op.cluster_distances(df.repartition(5), "id", "v", block_rows=20)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.id, r.other): (r.own, r.n, r.total) for r in found.collect()}
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert len(got) == 1200
    for i in range(300):
        for c in range(4):
            assert got[id_of(i), c] == (label[i], (label == c).sum(), pytest.approx(apart[i, label == c].sum()))


def test_rows_of_one_id_are_added_and_no_rows_give_none(spark):
    df = spark.createDataFrame([(1, [0.0], 1), (1, [3.0], 1), (2, [4.0], 2)], "id long, v array<double>, cluster int")
    got = {(r.id, r.own, r.other): (r.n, r.total) for r in op.cluster_distances(df, "id", "v").collect()}
    assert got == {(1, 1, 1): (4, 6.0), (1, 1, 2): (2, 5.0), (2, 2, 1): (2, 5.0), (2, 2, 2): (1, 0.0)}
    assert op.cluster_distances(df.filter(F.col("id") > 9), "id", "v").count() == 0
