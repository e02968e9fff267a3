import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from launchlens import operators as op


@pytest.fixture
def rows(frame):
    rng = random.Random(11)
    return frame([(i, rng.choice([0.0, 0.0, rng.expovariate(1)])) for i in range(500)], "id int, y double")


@pytest.mark.parametrize("digits", [1, 3])
def test_hash_rank_is_a_row_number(rows, digits):
    stratum = F.col("id") % 3
    ranked = op.hash_rank(rows, ["id"], 5, stratum, digits)
    w = Window.partitionBy(F.col("id") % 3).orderBy(F.md5(F.concat_ws("|", F.lit("5"), F.col("id").cast("string"))))
    both = ranked.withColumn("want", F.row_number().over(w))
    assert both.filter("hash_rank <> want").count() == 0
    assert both.count() == 500


def test_split_shares(rows):
    out = op.stratified_split(rows, "y", ["id"], 0.7, seed=1)
    assert out.columns == ["id", "y", "is_train"]
    q = op.exact_quantiles(rows, ["y"], [0.25, 0.5, 0.75])["y"]
    cuts = sorted({c for c in q if c > 0.0})
    sizes = {}
    for r in out.collect():
        s = sum(r.y > c for c in cuts)
        n, t = sizes.get(s, (0, 0))
        sizes[s] = (n + 1, t + r.is_train)
    assert all(t == math.ceil(0.7 * n) for n, t in sizes.values())


def test_split_repeats_and_follows_the_seed(rows):
    def ids(seed, partitions):
        out = op.stratified_split(rows.repartition(partitions), "y", ["id"], seed=seed)
        return {r.id for r in out.filter("is_train").collect()}

    assert ids(1, 2) == ids(1, 7) != ids(2, 2)


@pytest.mark.parametrize("y", [None, "y"])
def test_folds_partition_the_rows(rows, y):
    out = op.assign_folds(rows, 5, ["id"], 3, y=y)
    sizes = {r.fold: r.n for r in out.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert sorted(sizes) == [0, 1, 2, 3, 4] and sum(sizes.values()) == 500
    assert max(sizes.values()) - min(sizes.values()) <= (1 if y is None else 4)
