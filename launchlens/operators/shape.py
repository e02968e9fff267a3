"""Schema shaping: casts, projections and alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from launchlens.functions import to_date_col

__all__ = ["align_to", "conform", "dealt", "keep_ids", "select_numeric", "tag_channel"]


def conform(df: DataFrame, spec: T.StructType, fmt: str | None = None) -> DataFrame:
    """Cast the columns named in ``spec`` to its types; values that do not cast become NULL.

    Other columns pass through, and columns of ``spec`` the frame lacks are left out.
    """
    have = {f.name.lower(): f.dataType for f in df.schema.fields}
    casts = {}
    for field in spec.fields:
        source = have.get(field.name.lower())
        if source is None or source == field.dataType:
            continue
        if isinstance(source, T.StringType) and isinstance(field.dataType, T.DateType):
            casts[field.name] = to_date_col(field.name, fmt)
        else:
            casts[field.name] = F.col(field.name).try_cast(field.dataType)
    return df.withColumns(casts) if casts else df


def select_numeric(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """All numeric columns but the excluded ones."""
    return df.select(*[
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ])


def tag_channel(df: DataFrame, value: str, name: str = "channel") -> DataFrame:
    return df.withColumn(name, F.lit(value))


def align_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` in its order, with typed NULLs for those missing."""
    have = {c.lower() for c in df.columns}
    return df.select(*[
        (F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def keep_ids(df: DataFrame, ids: Sequence[str], suffix: str = "_id") -> DataFrame:
    """Copy identity columns aside so they survive model preparation."""
    return df.withColumns({f"{c}{suffix}": F.col(c) for c in ids})


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys together, in as many partitions as the session shuffles into.

    Adaptive execution merges other shuffles until a partition has its advisory size, and
    puts joins and aggregates that agree on their keys into one task, which then holds
    several hash tables of all its rows at once. A counted deal is not merged and
    begins a stage, so what a task holds shrinks with the number of partitions. Spark leaves
    out a deal by just the keys that the rows were joined by, so these are not enough.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
