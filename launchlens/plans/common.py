"""Steps both workflows share."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchlens import operators as op
from launchlens.sources import POS_LINES, WEB_LINES

__all__ = [
    "Matrix", "clean_pos", "clean_sales", "clean_web", "clustered", "design_matrix", "elbow", "evaluate_fit", "split_rows",
]


def clean_sales(df: DataFrame, key: str, measures: Sequence[str]) -> DataFrame:
    """Sales lines without the orders that net out negative."""
    return op.drop_negative_groups(df, key, measures)


def clean_web(raw: DataFrame, entry_method: int = 21) -> DataFrame:
    """Web lines of one entry method, typed, without net-return orders."""
    lines = op.conform(raw, WEB_LINES).filter(F.col("order_entry_method") == entry_method)
    lines = lines.drop("order_entry_method")
    return clean_sales(lines, "order_number", ("amount", "confirmed_quantity"))


def clean_pos(raw: DataFrame) -> DataFrame:
    """Store lines, typed, without net-return slips."""
    return clean_sales(op.conform(raw, POS_LINES), "slip", ("net_sale_amount", "sale_quantity"))


def clustered(
    profile: DataFrame, cols: Sequence[str], k: int, starts: int, max_iter: int, seed: int, key: str = "pattern"
) -> DataFrame:
    """A profile, one row per key, with cluster, nearest other cluster and silhouette width, on z-scores."""
    profile = op.materialize(profile)
    scaled = op.zscore(profile, cols)
    fit = op.kmeans_fit(scaled, cols, k, starts, max_iter, seed, key=[key])
    labelled = op.materialize(op.assign_clusters(scaled, fit).select(key, "cluster", *cols))
    widths = op.silhouette(labelled, key, cols).select(key, "neighbor", "sil_width")
    return profile.join(labelled.select(key, "cluster"), key, "left").join(widths, key, "left")


def elbow(
    profile: DataFrame, cols: Sequence[str], ks: Sequence[int], starts: int, max_iter: int, seed: int, key: str = "pattern"
) -> DataFrame:
    """Least k-means cost of a profile's z-scores for each number of clusters."""
    return op.elbow_curve(op.zscore(op.materialize(profile), cols), cols, ks, starts, max_iter, seed, key=[key])


@dataclass(frozen=True)
class Matrix:
    """A model table ready to fit: the frame, its target, its feature and identity columns, and the rows left out."""

    df: DataFrame
    y: str
    xs: list[str]
    ids: list[str]
    left_out: DataFrame


def design_matrix(
    df: DataFrame, y: str, numeric: Sequence[str], categorical: Sequence[str], ids: Sequence[str],
    missing: str = "leave_out",
) -> Matrix:
    """Dummies for the categorical columns, then no linear combinations, which constants are too.

    The model table is a rollup, small beside the sales, and every step from
    here on reads it again, so it is materialised first. A row with a hole cannot be
    fitted: ``missing`` says whether it is left out, and then listed in ``left_out``
    with the columns at fault, or whether it is an error (``raise``). Where all rows are
    left out, the matrix has no rows and no features.
    """
    if missing not in ("leave_out", "raise"):
        raise ValueError(f"missing must be leave_out or raise, not {missing}")
    held = {f"{c}_id": F.col(c) for c in ids}
    holes = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in (y, *numeric)])
    rows = op.materialize(
        df.select(*[F.col(c).cast("double").alias(c) for c in (y, *numeric)], *categorical,
                  *[c.alias(n) for n, c in held.items()])
        .withColumn("_missing", holes)
    )
    left_out = rows.filter(F.col("_missing") != "").select(*held, F.col("_missing").alias("missing"))
    if missing == "raise" and not left_out.isEmpty():
        raise ValueError("rows with missing values: see the columns " + left_out.first()["missing"])
    table = rows.filter(F.col("_missing") == "").drop("_missing")
    coded, dummies = op.one_hot(table, categorical)
    xs = [*numeric, *dummies]
    # Without a complete row every column is a constant, and constants go.
    redundant = set(xs) if table.isEmpty() else set(op.linear_combos(coded, xs))
    xs = [x for x in xs if x not in redundant]
    return Matrix(op.materialize(coded.select(y, *xs, *held)), y, xs, list(held), left_out)


def split_rows(m: Matrix, train_share: float, folds: int, seed: int) -> DataFrame:
    """Matrix rows marked as training or test; training rows have a fold."""
    keys = [*m.ids, *m.xs]
    marked = op.materialize(op.stratified_split(m.df, m.y, keys, train_share, seed=seed))
    train = op.assign_folds(marked.filter("is_train"), folds, keys, seed, y=m.y)
    test = marked.filter(~F.col("is_train")).withColumn("fold", F.lit(None).cast("int"))
    return op.materialize(train.unionByName(test))


def evaluate_fit(
    scored: DataFrame, y: str, label: str, offset: float = 0.0, pred: str = "prediction"
) -> DataFrame:
    """RMSE, R squared and MAE in original units, on the training and the test rows."""
    pairs = op.obs_pred(scored, y, pred, offset, keep=["is_train"])
    return op.regression_metrics(pairs, by=["is_train"]).select(
        F.lit(label).alias("model"),
        F.when(F.col("is_train"), "train").otherwise("test").alias("part"),
        "rmse", "r2", "mae",
    )
