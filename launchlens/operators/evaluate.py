"""Scores of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchlens.functions import back_transform

__all__ = ["obs_pred", "regression_metrics"]


def obs_pred(
    df: DataFrame, obs: str, pred: str, offset: float | None = 0.0, keep: Sequence[str] = ()
) -> DataFrame:
    """Observed and predicted values in original units, for columns on the log scale.

    ``offset`` is what the back-transform takes off again; None leaves the
    values as they are.
    """
    def units(c: str):
        return F.col(c) if offset is None else back_transform(c, offset)

    return df.select(*keep, units(obs).alias("obs"), units(pred).alias("pred"))


def regression_metrics(
    df: DataFrame, obs: str = "obs", pred: str = "pred", by: Sequence[str] = ()
) -> DataFrame:
    """RMSE, R squared and MAE in one aggregate, for the whole frame or by group.

    R squared is the squared correlation of observed and predicted values, NULL where one of them does not vary.
    """
    o, p = F.col(obs), F.col(pred)
    error = o - p
    return df.groupBy(*by).agg(
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.try_divide(F.pow(F.covar_pop(o, p), F.lit(2.0)), F.var_pop(o) * F.var_pop(p)).alias("r2"),
        F.avg(F.abs(error)).alias("mae"),
    )
