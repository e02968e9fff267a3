"""Column profiles: counts, NULLs, skewness, histograms, variance and correlation checks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = [
    "correlation_filter",
    "correlation_pairs",
    "histogram",
    "near_zero_var",
    "null_profile",
    "skewness_profile",
    "value_counts",
]


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def _to_rows(df: DataFrame, cols: Sequence[str], name: str, value: str) -> DataFrame:
    """Columns of one row turned into rows."""
    pairs = [F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in cols]
    return df.select(F.explode(F.array(*pairs)).alias("_p")).select("_p.*")


def null_profile(df: DataFrame) -> DataFrame:
    """NULLs per column, in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return _to_rows(counts, df.columns, "column", "n_null")


def skewness_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Skewness (population form) per column, in one pass."""
    return _to_rows(df.agg(*[F.skewness(c).alias(c) for c in cols]), cols, "column", "skewness")


def histogram(df: DataFrame, col: str, bins: int = 20, log: bool = False) -> DataFrame:
    """Rows per equal-width bin (numbered from 0) of a column or of its log.

    The two ends are found by a first aggregate; values without a log are left out.
    """
    v: Column = F.col(col).cast("double")
    values = df.select((F.log(v) if log else v).alias("v")).filter(F.col("v").isNotNull())
    low, high = values.agg(F.min("v"), F.max("v")).first()
    if low is None or low == high:
        bin_ = F.lit(0)
    else:
        bin_ = F.least(F.width_bucket("v", F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)) - 1
    return values.groupBy(bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def near_zero_var(
    df: DataFrame, cols: Sequence[str], freq_cut: float = 19.0, unique_cut: float = 10.0
) -> DataFrame:
    """Frequency ratio, share of unique values, and the two variance flags per column.

    The ratio is the commonest value's count over the runner-up's (0 when there
    is one value only). Values are counted first, so a hot value is one row.
    """
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols]
    counts = (
        df.select(F.explode(F.array(*pairs)).alias("_p"))
        .select("_p.*").filter(F.col("v").isNotNull())
        .groupBy("column", "v").agg(F.count("*").alias("n"))
    )
    top = counts.groupBy("column").agg(
        F.max("n").alias("_top"), F.count("*").alias("_unique"), F.sum("n").alias("_rows")
    )
    second = (
        counts.join(top, "column")
        .groupBy("column")
        .agg(
            F.count_if(F.col("n") == F.col("_top")).alias("_at_top"),
            F.max(F.when(F.col("n") < F.col("_top"), F.col("n"))).alias("_next"),
        )
    )
    ratio = (
        F.when(F.col("_unique") == 1, F.lit(0.0))
        .when(F.col("_at_top") > 1, F.lit(1.0))
        .otherwise(F.col("_top") / F.col("_next"))
    )
    unique = F.lit(100.0) * F.col("_unique") / F.col("_rows")
    zero = F.col("_unique") == 1
    return top.join(second, "column").select(
        "column",
        ratio.alias("freq_ratio"),
        unique.alias("percent_unique"),
        zero.alias("zero_var"),
        (zero | ((ratio > freq_cut) & (unique <= unique_cut))).alias("nzv"),
    )


def _correlation(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    vectors = VectorAssembler(inputCols=list(cols), outputCol="_v", handleInvalid="skip").transform(df)
    return Correlation.corr(vectors.select("_v"), "_v").first()[0].toArray()


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns (a, b), a before b in the list."""
    m = _correlation(df, cols)
    rows = [
        (cols[i], cols[j], float(m[i, j]))
        for i in range(len(cols)) for j in range(i + 1, len(cols))
    ]
    return df.sparkSession.createDataFrame(rows, "a string, b string, corr double")


def correlation_filter(df: DataFrame, cols: Sequence[str], cutoff: float = 0.85) -> list[str]:
    """Columns to drop so that no pair left correlates above the cut-off.

    Columns are visited from the highest mean absolute correlation down. Of a
    pair above the cut-off, the one whose mean over the columns still in play
    is higher goes.
    """
    m = np.abs(_correlation(df, cols))
    np.fill_diagonal(m, np.nan)
    alive = np.ones(len(cols), dtype=bool)
    order = np.argsort(-np.nanmean(m, axis=1), kind="stable")
    for x, i in enumerate(order):
        for j in order[x + 1:]:
            if not alive[i]:
                break
            if not alive[j] or not m[i, j] > cutoff:
                continue
            mean_i = np.nanmean(m[i, alive])
            mean_j = np.nanmean(m[np.ix_(alive & (np.arange(len(cols)) != j), alive)])
            alive[i if mean_i > mean_j else j] = False
    return [c for c, keep in zip(cols, alive) if not keep]
