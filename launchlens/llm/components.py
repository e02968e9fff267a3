"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchlens.llm.store import settled


def components(links: DataFrame) -> DataFrame:
    """node, label (the least node it is connected with) for the nodes of ``links`` (a, b: longs).

    Every round hangs each node's larger neighbours, then its smaller ones, on the
    least neighbour; the number of rounds grows with the logarithm of the longest
    path. A node with very many links is only ever aggregated or joined, and
    nothing but counts reaches the driver.
    """
    edges = settled(_edges(links))
    state = None
    while True:
        after = settled(_small_star(_large_star(edges)))
        found = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 40)).alias("s")).first()
        if state == (found["n"], found["s"]):
            break
        state, edges = (found["n"], found["s"]), after
    return after.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        after.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _edges(links: DataFrame) -> DataFrame:
    """Each link once, from the larger to the smaller node."""
    return links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _edges(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return _edges(edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        least.select("a", F.col("m").alias("b"))))
