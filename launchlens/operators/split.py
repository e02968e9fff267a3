"""Reproducible splits and folds with exact shares, without ranking a stratum in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from launchlens.operators.quantiles import exact_quantiles

__all__ = ["assign_folds", "hash_rank", "strata", "stratified_split"]


def strata(df: DataFrame, y: str, groups: int = 5) -> Column:
    """Right-closed interval (from 0) of a numeric column between its quantiles.

    ``groups`` quantiles from 0 to 1 make ``groups - 1`` intervals; equal
    quantiles merge.
    """
    probs = [i / (groups - 1) for i in range(groups)]
    cuts = sorted({q for q in exact_quantiles(df, [y], probs)[y] if q is not None})
    inner = cuts[1:-1]
    return reduce(lambda acc, c: acc + (F.col(y) > F.lit(c)).cast("int"), inner, F.lit(0))


def hash_rank(
    df: DataFrame, keys: Sequence[str], seed: int, stratum: Column | None = None, digits: int = 3
) -> DataFrame:
    """Rank (from 1) of each row by ``md5(seed|keys)`` in its stratum, and the stratum's size.

    Equals a row number over the stratum, but the rows are split by the first
    hex digits of their hash: a count per split gives each split its offset,
    and rows are ranked inside splits only. Hashes are uniform, so the splits
    are even whatever the data. ``keys`` must identify a row.
    """
    hashed = df.withColumns({
        "_h": F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])),
        "_stratum": stratum if stratum is not None else F.lit(0),
    }).withColumn("_part", F.substring("_h", 1, digits))
    sizes = hashed.groupBy("_stratum", "_part").agg(F.count("*").alias("_n"))
    # One row per split: at most 16**digits in a window partition.
    whole = Window.partitionBy("_stratum")
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_stratum", "_part",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_n").over(whole).alias("stratum_rows"),
    )
    inside = Window.partitionBy("_stratum", "_part").orderBy("_h")
    return (
        hashed.withColumn("_row", F.row_number().over(inside))
        .join(offsets, ["_stratum", "_part"])
        .withColumn("hash_rank", F.col("_offset") + F.col("_row"))
        .withColumnRenamed("_stratum", "stratum")
        .drop("_h", "_part", "_row", "_offset")
    )


def stratified_split(
    df: DataFrame, y: str, keys: Sequence[str], p: float = 0.7, groups: int = 5, seed: int = 1234
) -> DataFrame:
    """Adds ``is_train``: in each quantile stratum of y, the first ``ceil(p*n)`` rows by hash."""
    ranked = hash_rank(df, keys, seed, strata(df, y, groups))
    take = F.col("hash_rank") <= F.ceil(F.lit(float(p)) * F.col("stratum_rows"))
    return ranked.withColumn("is_train", take).drop("hash_rank", "stratum_rows", "stratum")


def assign_folds(
    df: DataFrame,
    k: int,
    keys: Sequence[str],
    seed: int = 1234,
    y: str | None = None,
    groups: int = 5,
) -> DataFrame:
    """Adds ``fold`` in 0..k-1: rows dealt out in hash order, inside strata of y if given."""
    ranked = hash_rank(df, keys, seed, strata(df, y, groups) if y else None)
    return ranked.withColumn(
        "fold", F.pmod(F.col("hash_rank") - 1, F.lit(k)).cast("int")
    ).drop("hash_rank", "stratum_rows", "stratum")
