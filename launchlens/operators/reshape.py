"""Long to wide, zero fill, sums of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchlens.functions import add_all

__all__ = ["add_cumulative", "pivot_wide", "zero_fill"]


def pivot_wide(
    df: DataFrame, ids: Sequence[str], key: str, keys: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """One row per distinct ``ids``, one column ``value_key`` per value and key.

    The keys are given, so no extra job looks for them. Every column in ``ids``
    is part of a row's identity: rows that differ in one of them stay apart. Of
    several values for one cell the largest counts.
    """
    cells = {
        f"{v}_{k}": F.max(F.when(F.col(key) == k, F.col(v)))
        for v in values for k in keys
    }
    return df.groupBy(*ids).agg(*[c.alias(name) for name, c in cells.items()])


def zero_fill(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """0 for NULL in the listed columns only."""
    return df.fillna(0, subset=list(cols))


def add_cumulative(df: DataFrame, name: str, parts: Sequence[str]) -> DataFrame:
    """Sum of columns; a NULL part makes it NULL."""
    return df.withColumn(name, add_all(parts))
