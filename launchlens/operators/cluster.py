"""Clustering of patterns: k-means with restarts, elbow costs, silhouettes.

All fits that are asked for at once, of every number of clusters and every start, go
through the rows together: a pass adds up, for each centre of each fit, the rows that
are nearest to it. So a sweep costs as many passes as its slowest fit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchlens.operators.materialize import materialize
from launchlens.operators.partials import batches_of, combined

__all__ = [
    "Clusters",
    "assign_clusters",
    "cluster_distances",
    "elbow_curve",
    "kmeans_fit",
    "kmeans_runs",
    "kmeans_sweep",
    "one_cluster_cost",
    "silhouette",
    "silhouette_score_squared",
]

#: Rows that a partition of a keyed fit holds at most, as far as the shuffle partitions allow.
PARTITION_ROWS = 50_000
#: Rows whose distances to all centres a task holds at a time.
BLOCK = 256


@dataclass
class Clusters:
    """A k-means fit: centres in ascending order (cluster 1 first), cost, and passes until it stood still."""

    centres: np.ndarray
    cols: list[str]
    cost: float
    k: int = 0
    start: int = 0
    passes: int = 0


def _placed(df: DataFrame, cols: Sequence[str], key: Sequence[str]) -> DataFrame:
    """The complete rows as doubles; with a key, on the same partition and in the same order every time.

    Sums of doubles depend on their order, if only in the last digits. A fit is dozens
    of passes, so a small frame is one partition.
    """
    rows = df.select(*key, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
    rows = rows.dropna(subset=[f"_x{i}" for i in range(len(cols))])
    if key:
        n = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + df.count() // PARTITION_ROWS)
        rows = rows.repartition(n, *key).sortWithinPartitions(*key)
    return rows.drop(*key)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the values of each row; equal rows have equal ones."""
    out = np.full(len(rows), 0x9E3779B97F4A7C15, np.uint64)
    for column in (rows + 0.0).T:
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + np.ascontiguousarray(column).view(np.uint64))
    return out


def _first_centres(rows: DataFrame, runs: Sequence[tuple[int, int]], width: int) -> np.ndarray | None:
    """For each (k, seed) the k different rows of least hash; places that no row takes are infinite."""
    edges = np.cumsum([0, *[k for k, _ in runs]])
    salts = _mixed(np.array([(seed << 20) + k for k, seed in runs], np.uint64))

    def least(found: np.ndarray) -> np.ndarray:
        """The least ranks of each run, once each, out of (run, rank, values) rows."""
        out = np.full((edges[-1], 2 + width), np.inf)
        for i, (k, _) in enumerate(runs):
            mine = found[found[:, 0] == i]
            _, first = np.unique(mine[:, 1], return_index=True)
            first = first[:k]
            out[edges[i]: edges[i] + len(first)] = mine[first]
        return out

    def state(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        best = np.full((edges[-1], 2 + width), np.inf)
        for block in batches_of(batches, 64 * BLOCK):
            hashes = _row_hashes(block)
            hashes, first = np.unique(hashes, return_index=True)
            block = block[first]
            candidates = [best]
            for i, (k, _) in enumerate(runs):
                rank = (_mixed(hashes ^ salts[i]) >> np.uint64(11)).astype(float)  # 53 bits, exact as a double
                near = np.argsort(rank, kind="stable")[:k]
                candidates.append(np.column_stack([np.full(len(near), i), rank[near], block[near]]))
            best = least(np.concatenate(candidates))
        return best.ravel()

    found = combined(rows, state, lambda a, b: least(np.concatenate([a.reshape(-1, 2 + width), b.reshape(-1, 2 + width)])).ravel())
    return None if found is None else found.reshape(-1, 2 + width)[:, 2:]


def _pass(rows: DataFrame, centres: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all fits at once: sums and counts of the rows nearest to each centre, and the cost of each fit.

    ``edges`` are the numbers of the first centre of each fit, and of all centres.
    """
    count, width, n = len(edges) - 1, centres.shape[1], len(centres)

    def state(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        sums, counts, cost = np.zeros((width, n)), np.zeros(n), np.zeros(count)
        for block in batches_of(batches, BLOCK):
            squared = np.zeros((len(block), n))
            for j in range(width):
                squared += np.subtract.outer(block[:, j], centres[:, j]) ** 2
            nearest = np.column_stack([a + squared[:, a:z].argmin(1) for a, z in zip(edges[:-1], edges[1:])])
            cost += np.take_along_axis(squared, nearest, 1).sum(0)
            flat = nearest.ravel()
            counts += np.bincount(flat, minlength=n)
            for j in range(width):
                sums[j] += np.bincount(flat, np.repeat(block[:, j], count), minlength=n)
        return np.concatenate([sums.ravel(), counts, cost])

    found = combined(rows, state, np.add)
    return found[: width * n].reshape(width, n).T, found[width * n: -count], found[-count:]


def kmeans_runs(
    df: DataFrame,
    cols: Sequence[str],
    ks: Sequence[int],
    n_start: int = 20,
    max_iter: int = 100,
    seed: int = 1,
    key: Sequence[str] = (),
) -> list[Clusters]:
    """Every fit of every number of clusters, from ``n_start`` sets of starting rows each.

    A start takes different rows by a hash of their values, so it does not depend on
    their order. With fewer different rows than clusters each row is a cluster; an
    empty cluster keeps its centre. Rows with a NULL take no part; without rows
    there are no fits.
    """
    rows = _placed(df, cols, key).persist()
    try:
        runs = [(k, seed + start) for k in ks for start in range(n_start if k > 1 else 1)]
        first = _first_centres(rows, runs, len(cols))
        if first is None:
            return []
        bounds = np.cumsum([0, *[k for k, _ in runs]])
        centres = [first[a:z] for a, z in zip(bounds[:-1], bounds[1:])]
        cost, passes = [float("inf")] * len(runs), [0] * len(runs)
        active = list(range(len(runs)))
        while active:
            edges = np.cumsum([0, *[len(centres[i]) for i in active]])
            sums, counts, costs = _pass(rows, np.concatenate([centres[i] for i in active]), edges)
            still = []
            for at, i in enumerate(active):
                part = slice(edges[at], edges[at + 1])
                size = counts[part, None]
                moved = np.where(size > 0, sums[part] / np.maximum(size, 1), centres[i])
                cost[i] = float(costs[at])
                if passes[i] < max_iter and not np.array_equal(moved, centres[i]):
                    centres[i], passes[i] = moved, passes[i] + 1
                    still.append(i)
            active = still
        fits = []
        for (k, s), c, total, n in zip(runs, centres, cost, passes):
            c = c[np.isfinite(c).all(1)]
            fits.append(Clusters(c[np.lexsort(c.T[::-1])], list(cols), total, k, s - seed, n))
        return fits
    finally:
        rows.unpersist()


def kmeans_sweep(df: DataFrame, cols: Sequence[str], ks: Sequence[int], n_start: int = 20, max_iter: int = 100, seed: int = 1,
                 key: Sequence[str] = ()) -> dict[int, Clusters]:
    """The cheapest fit of each number of clusters; of equally cheap ones the first start."""
    best: dict[int, Clusters] = {}
    for fit in kmeans_runs(df, cols, ks, n_start, max_iter, seed, key):
        if fit.k not in best or fit.cost < best[fit.k].cost:
            best[fit.k] = fit
    return best


def kmeans_fit(
    df: DataFrame,
    cols: Sequence[str],
    k: int,
    n_start: int = 20,
    max_iter: int = 100,
    seed: int = 1,
    key: Sequence[str] = (),
) -> Clusters:
    """The cheapest of several seeded k-means fits.

    ``key`` identifies a row and makes the fit repeat to the last digit whatever order rows come in.
    """
    found = kmeans_sweep(df, cols, [k], n_start, max_iter, seed, key)
    if not found:
        raise ValueError("no complete rows to cluster")
    return found[k]


def assign_clusters(df: DataFrame, clusters: Clusters) -> DataFrame:
    """Adds the ``cluster`` of each row, the nearest centre (of equally near ones the first); NULL for a row with a NULL feature."""
    def distance(centre: np.ndarray):
        parts = [F.pow(F.col(c).cast("double") - F.lit(float(v)), F.lit(2.0)) for c, v in zip(clusters.cols, centre)]
        return F.aggregate(F.array(*parts), F.lit(0.0), lambda a, b: a + b)

    near = [F.struct(distance(c).alias("d"), F.lit(i + 1).alias("cluster")) for i, c in enumerate(clusters.centres)]
    complete = F.lit(True)
    for c in clusters.cols:
        complete = complete & F.col(c).isNotNull()
    return df.withColumn("cluster", F.when(complete, F.array_min(F.array(*near))["cluster"]))


def one_cluster_cost(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cost of a single cluster: squared distances to the mean, summed (one row)."""
    complete = df.select(*[F.col(c).cast("double") for c in cols]).dropna()
    parts = [F.coalesce(F.regr_sxx(F.lit(1.0), F.col(c)), F.lit(0.0)) for c in cols]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return complete.agg(total.alias("cost")).select(F.lit(1).alias("k"), "cost")


def elbow_curve(
    df: DataFrame,
    cols: Sequence[str],
    ks: Sequence[int] = tuple(range(1, 16)),
    n_start: int = 20,
    max_iter: int = 100,
    seed: int = 1,
    key: Sequence[str] = (),
) -> DataFrame:
    """Lowest cost found for each number of clusters, as rows (k, cost), out of one sweep."""
    best = kmeans_sweep(df, cols, ks, n_start, max_iter, seed, key)
    return df.sparkSession.createDataFrame([(k, best[k].cost) for k in ks if k in best], "k int, cost double")


def cluster_distances(
    df: DataFrame, id_col: str, vector: str, cluster: str = "cluster", block_rows: int = 1024
) -> DataFrame:
    """Euclidean distances of every row to all rows, added up by the other row's cluster.

    Returns (id, own, other, n, total). This is all a silhouette needs of the
    distance matrix, so no pair of rows is ever a record: rows are packed into
    blocks of up to ``block_rows``, and each block meets all blocks, which are read from the
    checkpoint one after the other, in one task, which adds up distances in numpy. So rows are stored
    once, no copies are shuffled, and a task holds two blocks. The work
    grows with the square of the rows, which exact Euclidean silhouettes cannot avoid,
    but no group grows; use ``silhouette_score_squared`` where squared distances do, in
    linear time.

    ``vector`` is an array column; see :func:`silhouette` for scalar columns.
    """
    spark = df.sparkSession
    single = df.schema[vector].dataType.simpleString() == "array<float>"
    points = df.select(
        F.col(id_col).alias("id"), F.col(cluster).cast("int").alias("own"),
        F.col(vector) if single else F.col(vector).cast("array<double>"),
    ).toDF("id", "own", "v").dropna()
    places = 4 * spark.sparkContext.defaultParallelism
    rows = points.count()
    n_blocks = max(1, -(-rows // max(1, min(block_rows, max(64, -(-rows // places))))))
    id_type, kept = points.schema["id"].dataType.simpleString(), np.float32 if single else np.float64
    schema = f"id {id_type}, own int, other int, n bigint, total double"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's rows, which are next to each other, as one record."""
        def record(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts)
            ids = pa.BufferOutputStream()
            with pa.ipc.new_stream(ids, table.select(["id"]).schema) as out:
                out.write_table(table.select(["id"]))
            own, v = table.column("own").to_numpy().astype(np.int32), table.column("v").combine_chunks()
            sizes = np.asarray(pa.compute.list_value_length(v))
            if (sizes != sizes[0]).any() or v.flatten().null_count:
                raise ValueError("vectors differ in length or have holes")
            return pa.RecordBatch.from_arrays([
                pa.array([table.column("block")[0].as_py()], pa.int32()), pa.array([ids.getvalue().to_pybytes()], pa.binary()),
                pa.array([own.tobytes()], pa.binary()), pa.array([v.flatten().to_numpy().astype(kept).tobytes()], pa.binary())],
                ["block", "ids", "own", "v"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for a, z in zip(edges[:-1], edges[1:]):
                if z > a:
                    if held and held[-1].column("block")[0].as_py() != blocks[a]:
                        yield record(held)
                        held = []
                    held.append(batch.slice(a, z - a))
        if held:
            yield record(held)

    def meet(pairs: Iterator[tuple]) -> Iterator[tuple[bytes]]:
        """The sums of each block on the left, complete once it has met all on the right."""
        open_: dict[int, list] = {}
        for left, right in pairs:
            if left["block"] not in open_:
                own = np.frombuffer(left["own"], np.int32)
                open_[left["block"]] = [0, own, np.frombuffer(left["v"], kept).reshape(len(own), -1).astype(float), {}]
            state = open_[left["block"]]
            state[0] += 1
            labels = np.frombuffer(right["own"], np.int32)
            _add_distances(state[3], state[2], np.frombuffer(right["v"], kept).reshape(len(labels), -1).astype(float), labels)
            if state[0] == met:
                _, own, _, sums = open_.pop(left["block"])
                yield (finished(bytes(left["ids"]), own, sums),)

    def finished(ids: bytes, own: np.ndarray, sums: dict[int, tuple]) -> bytes:
        column = pa.ipc.open_stream(ids).read_all().column("id").combine_chunks()
        others = sorted(sums)
        table = pa.table({
            "id": pa.concat_arrays([column] * len(others)), "own": pa.array(np.tile(own, len(others))),
            "other": pa.array(np.repeat(np.array(others, np.int32), len(own))),
            "n": pa.array(np.repeat(np.array([sums[o][0] for o in others], np.int64), len(own))),
            "total": pa.array(np.concatenate([sums[o][1] for o in others]))})
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as stream:
            stream.write_table(table)
        return out.getvalue().to_pybytes()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("rows"):
                yield from pa.ipc.open_stream(raw.as_buffer()).read_all().to_batches()

    block = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")
    # sums of doubles depend on the order, so blocks and their rows have one
    ordered = points.select(block.alias("block"), "*").repartitionByRange(min(n_blocks, places), "block").sortWithinPartitions("block", "own", "id", "v")
    packed = materialize(ordered.mapInArrow(pack, "block int, ids binary, own binary, v binary"))
    met = packed.count()
    if not met:
        return spark.createDataFrame([], schema)
    sums = packed.rdd.cartesian(packed.rdd.coalesce(1)).mapPartitions(meet)
    return (
        spark.createDataFrame(sums, "rows binary").mapInArrow(unpack, schema)
        .groupBy("id", "own", "other").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    )


def _add_distances(sums: dict[int, tuple], x: np.ndarray, y: np.ndarray, labels: np.ndarray) -> None:
    """Adds to ``sums`` (number and distances by label) what the rows of ``y``, whose ``labels`` ascend, are away from each of ``x``."""
    first = np.flatnonzero(np.concatenate([[True], labels[1:] != labels[:-1]]))
    edges = [*first.tolist(), len(labels)]
    for a, z in zip(edges[:-1], edges[1:]):
        total = np.zeros(len(x))
        for begin in range(a, z, BLOCK):
            some = y[begin: min(begin + BLOCK, z)]
            squared = np.zeros((len(some), len(x)))
            step = np.empty_like(squared)
            for j in range(x.shape[1]):
                np.subtract.outer(some[:, j], x[:, j], out=step)
                np.multiply(step, step, out=step)
                squared += step
            total += np.sqrt(squared, out=squared).sum(0)
        n, so_far = sums.get(int(labels[a]), (0, 0.0))
        sums[int(labels[a])] = (n + z - a, so_far + total)


def silhouette(
    df: DataFrame,
    id_col: str,
    cols: Sequence[str] | str,
    cluster: str = "cluster",
    block_rows: int = 1024,
) -> DataFrame:
    """Silhouette width per row: (id, cluster, neighbor, sil_width).

    ``cols`` is a list of numeric columns or the name of an array column. A
    row alone in its cluster has width 0.
    """
    if isinstance(cols, str):
        points, vector = df, cols
    else:
        # An incomplete row has no distances.
        points = df.dropna(subset=list(cols)).withColumn("_v", F.array(*[F.col(c).cast("double") for c in cols]))
        vector = "_v"
    sums = cluster_distances(points, id_col, vector, cluster, block_rows)
    mine = F.col("other") == F.col("own")
    mean = F.col("total") / F.col("n")
    per_row = sums.groupBy("id", "own").agg(
        F.max(F.when(mine, F.try_divide(F.col("total"), F.col("n") - 1))).alias("a"),
        F.min(F.when(~mine, F.struct(mean.alias("b"), "other"))).alias("near"),
    )
    width = F.when(F.col("a").isNull(), F.lit(0.0)).otherwise(
        F.try_divide(F.col("near.b") - F.col("a"), F.greatest("a", "near.b"))
    )
    return per_row.select(
        F.col("id").alias(id_col), F.col("own").alias("cluster"),
        F.col("near.other").alias("neighbor"), width.alias("sil_width"),
    )


def silhouette_score_squared(
    df: DataFrame, cols: Sequence[str], cluster: str = "cluster"
) -> float:
    """Mean silhouette on squared Euclidean distances, in one pass over the rows."""
    vectors = VectorAssembler(inputCols=list(cols), outputCol="_features").transform(df.dropna(subset=[*cols, cluster]))
    labelled = vectors.withColumn("_label", F.col(cluster).cast("int"))
    return ClusteringEvaluator(featuresCol="_features", predictionCol="_label").evaluate(labelled)
