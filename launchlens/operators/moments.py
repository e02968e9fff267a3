"""Cross products of model columns: one pass, p x p numbers on the driver.

Least squares, backward elimination, the lasso and the search for linear
combinations need nothing else of the data, however many rows it has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = ["CrossProducts", "cross_products"]


@dataclass
class CrossProducts:
    """Z'Z per fold, where Z is an intercept and the centred, scaled columns."""

    cols: list[str]
    mean: np.ndarray
    scale: np.ndarray
    folds: dict[int, np.ndarray]

    def gram(self, without: int | None = None) -> np.ndarray:
        """Z'Z over all rows, or over all but one fold."""
        return sum(g for f, g in self.folds.items() if f != without)


def cross_products(df: DataFrame, cols: Sequence[str], fold: str | None = None) -> CrossProducts:
    """Cross products of columns, split by fold if asked; rows with a NULL are left out.

    The columns are centred and scaled by a first aggregate, which keeps the
    products well conditioned. Tasks add up their batches in numpy and hand
    over p*p/2 numbers each, which a grouped sum combines.
    """
    cols = list(cols)
    by = F.col(fold).cast("int") if fold else F.lit(0)
    data = df.select(by.alias("_fold"), *[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    stats = data.agg(*[f(c).alias(f"{p}{i}") for i, c in enumerate(cols)
                       for p, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    if not cols or stats["m0"] is None:
        raise ValueError("no complete rows")
    mean = np.array([stats[f"m{i}"] for i in range(len(cols))])
    dev = np.array([stats[f"s{i}"] or 0.0 for i in range(len(cols))])
    # Rounding leaves a constant column a tiny deviation; treat it as none.
    constant = dev <= 1e-12 * np.maximum(1.0, np.abs(mean))
    scale = np.where(constant, 1.0, dev)
    size = len(cols) + 1
    upper = np.triu_indices(size)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            z = (batch[cols].to_numpy() - mean) / scale
            z[:, constant] = 0.0
            z = np.column_stack([np.ones(len(z)), z])
            labels = batch["_fold"].to_numpy()
            for f in np.unique(labels):
                part = z[labels == f]
                sums[int(f)] = sums.get(int(f), 0.0) + part.T @ part
        for f, g in sums.items():
            yield pd.DataFrame({"fold": f, "i": upper[0], "j": upper[1], "v": g[upper]})

    rows = (
        data.mapInPandas(partial, "fold int, i int, j int, v double")
        .groupBy("fold", "i", "j").agg(F.sum("v").alias("v"))
        .toPandas()  # folds * p * p / 2 rows
    )
    folds = {}
    for f, part in rows.groupby("fold"):
        g = np.zeros((size, size))
        g[part["i"], part["j"]] = part["v"]
        folds[int(f)] = np.triu(g) + np.triu(g, 1).T
    return CrossProducts(cols, mean, scale, folds)
