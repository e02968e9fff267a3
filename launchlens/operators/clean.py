"""Removing net-return orders, and the row filters of the workflow."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from launchlens.functions import add_all, exact_sum

__all__ = [
    "cleaning_audit",
    "drop_burst_only",
    "drop_negative_groups",
    "exclude_values",
    "first_buckets",
    "keep_sold_skus",
    "keep_values",
    "launched_between",
    "negative_groups",
    "require_non_negative",
]


def _any_negative(measures: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [exact_sum(m) < 0 for m in measures])


def negative_groups(df: DataFrame, key: str, measures: Sequence[str]) -> DataFrame:
    """Distinct keys for which the sum of any measure is below 0, in one pass."""
    return (
        df.groupBy(key)
        .agg(F.coalesce(_any_negative(measures), F.lit(False)).alias("_negative"))
        .filter("_negative")
        .select(key)
    )


def drop_negative_groups(df: DataFrame, key: str, measures: Sequence[str]) -> DataFrame:
    """Lines whose group is not net negative; lines without a key stay.

    An anti join and not a window over the key: the aggregate combines before
    its shuffle, and a hot key is split by adaptive execution.
    """
    return df.join(negative_groups(df, key, measures), key, "left_anti")


def cleaning_audit(df: DataFrame, key: str, measures: Sequence[str]) -> DataFrame:
    """Distinct keys before cleaning, removed by it and left after it (one row)."""
    flags = (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.coalesce(_any_negative(measures), F.lit(False)).alias("_negative"))
    )
    return flags.agg(
        F.count("*").alias("n_before"),
        F.count_if("_negative").alias("n_removed"),
        F.count_if(~F.col("_negative")).alias("n_after"),
    )


def keep_sold_skus(skus: DataFrame, *sales: DataFrame, sku: str = "sku") -> DataFrame:
    """Master rows sold in any of the given sales frames.

    Keys are made distinct inside each frame first, so the union that is
    shuffled to the semi join holds keys and not sales lines.
    """
    keys = reduce(DataFrame.union, [s.select(sku).distinct() for s in sales])
    return skus.join(keys, sku, "left_semi")


def exclude_values(df: DataFrame, col: str, values: Iterable[object]) -> DataFrame:
    """Rows whose value is none of these; NULL goes too."""
    return df.filter(~F.col(col).isin(*values))


def keep_values(df: DataFrame, col: str, values: Iterable[object]) -> DataFrame:
    return df.filter(F.col(col).isin(*values))


def launched_between(
    df: DataFrame, low: object = None, high: object = None, col: str = "launch_date"
) -> DataFrame:
    """Rows with a date in [low, high]; either end may be open."""
    if low is not None:
        df = df.filter(F.col(col) >= F.lit(low).cast("date"))
    if high is not None:
        df = df.filter(F.col(col) <= F.lit(high).cast("date"))
    return df


def first_buckets(
    df: DataFrame, tags: Iterable[str] = ("1W", "2W", "3W"), col: str = "group_tag"
) -> DataFrame:
    return keep_values(df, col, tags)


def require_non_negative(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [F.col(c) >= 0 for c in cols]))


def drop_burst_only(
    df: DataFrame, target: str, parts: Sequence[str], limit: float = 1000
) -> DataFrame:
    """Drop rows that sold over ``limit`` early and no more than that afterwards."""
    return df.filter(~((F.col(target) <= limit) & (add_all(parts) > limit)))
