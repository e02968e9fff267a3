"""Filling overlap features of launches too early to have a full window behind them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = ["ImputeRule", "donor_means", "impute_early"]


@dataclass(frozen=True)
class ImputeRule:
    """Launches up to ``cutoff`` take the group's mean over the later ones."""

    cutoff: str
    count_col: str
    mean_col: str


def donor_means(
    df: DataFrame, keys: Sequence[str], rules: Sequence[ImputeRule], launch: str = "launch_date"
) -> DataFrame:
    """Per group, the mean count (rounded up) and mean value of launches after each cut-off.

    All rules share one aggregate. A group without donors gets NULL.
    """
    aggs = []
    for r in rules:
        later = F.col(launch) > F.lit(r.cutoff).cast("date")
        aggs += [
            F.ceil(F.avg(F.when(later, F.col(r.count_col)))).cast("double").alias(f"_d_{r.count_col}"),
            F.avg(F.when(later, F.col(r.mean_col))).alias(f"_d_{r.mean_col}"),
        ]
    return df.groupBy(*keys).agg(*aggs)


def impute_early(
    df: DataFrame,
    keys: Sequence[str],
    rules: Sequence[ImputeRule],
    launch: str = "launch_date",
    fallback: bool = False,
) -> DataFrame:
    """Replace the columns of early launches by donor means.

    Without a donor the value becomes NULL; with ``fallback`` it keeps its own.
    """
    out = df.join(donor_means(df, keys, rules, launch), list(keys), "left")
    new = {}
    for r in rules:
        early = F.col(launch) <= F.lit(r.cutoff).cast("date")
        for c in (r.count_col, r.mean_col):
            donor = F.coalesce(f"_d_{c}", F.col(c)) if fallback else F.col(f"_d_{c}")
            new[c] = F.when(early, donor).otherwise(F.col(c))
    donors = [f"_d_{c}" for r in rules for c in (r.count_col, r.mean_col)]
    return out.withColumns(new).drop(*donors)
