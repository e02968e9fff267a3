"""Exact quantiles of many columns without gathering a column anywhere.

Spark's exact ``percentile`` merges every distinct value of a column in one
task. Here each pass counts rows in equal bins of the interval that still holds
a wanted rank, and the next pass looks only inside that rank's bin, until the
bin is one value or small enough to sort. A pass is one aggregate over the data
that combines before its shuffle; the driver sees bin counts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = ["exact_quantiles", "quantile_table"]


@dataclass
class _Search:
    """A wanted rank (from 0) of one column, and the interval it is known to be in."""

    col: str
    rank: int
    low: float
    high: float
    below: int
    inside: int

    @property
    def done(self) -> bool:
        return self.low == self.high


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    bins: int = 512,
    sort_limit: int = 10_000,
) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation between order statistics, NULL and NaN left out.

    Runs eagerly, a few passes over ``df``: materialise an expensive input first.
    """
    values = df.select(*[
        F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"_{i}")
        for i, c in enumerate(cols)
    ])
    name = {c: f"_{i}" for i, c in enumerate(cols)}
    ends = values.agg(*[
        f(name[c]).alias(f"{name[c]}_{tag}")
        for c in cols for tag, f in (("n", F.count), ("lo", F.min), ("hi", F.max))
    ]).first()

    searches: dict[tuple[str, int], _Search] = {}
    for c in cols:
        n = ends[f"{name[c]}_n"]
        if n and math.isinf(ends[f"{name[c]}_hi"] - ends[f"{name[c]}_lo"]):
            raise ValueError(f"{c} holds infinite or too widely spread values")
        for p in probs if n else ():
            spot = (n - 1) * p
            for rank in {math.floor(spot), math.ceil(spot)}:
                searches[c, rank] = _Search(
                    name[c], rank, ends[f"{name[c]}_lo"], ends[f"{name[c]}_hi"], 0, n
                )

    while any(not s.done and s.inside > sort_limit for s in searches.values()):
        _narrow(values, [s for s in searches.values() if not s.done], bins)
    _sort_inside(values, [s for s in searches.values() if not s.done])

    out: dict[str, list[float | None]] = {}
    for c in cols:
        n = ends[f"{name[c]}_n"]
        out[c] = []
        for p in probs:
            if not n:
                out[c].append(None)
                continue
            spot = (n - 1) * p
            a, b = searches[c, math.floor(spot)].low, searches[c, math.ceil(spot)].low
            out[c].append(a + (spot - math.floor(spot)) * (b - a))
    return out


def _intervals(searches: Sequence[_Search]) -> dict[tuple[str, float, float], list[_Search]]:
    """Searches by interval: at first all ranks of a column share one, later neighbours do."""
    out: dict[tuple[str, float, float], list[_Search]] = {}
    for s in searches:
        out.setdefault((s.col, s.low, s.high), []).append(s)
    return out


def _spread(values: DataFrame, intervals: Sequence[tuple[str, float, float]], cell) -> DataFrame:
    """One row (at, ...) per value and interval that holds it."""
    cells = [
        F.when(F.col(c).between(F.lit(low), F.lit(high)), cell(i, c, low, high))
        for i, (c, low, high) in enumerate(intervals)
    ]
    exploded = values.select(F.explode(F.array(*cells)).alias("c"))
    return exploded.filter(F.col("c").isNotNull()).select("c.*")


def _narrow(values: DataFrame, searches: Sequence[_Search], bins: int) -> None:
    """Move each search to the bin of its interval that holds its rank."""
    def cell(i: int, c: str, low: float, high: float) -> F.Column:
        spot = (F.col(c) - F.lit(low)) / F.lit(high - low) * bins
        return F.struct(
            F.lit(i).alias("at"), F.least(F.floor(spot), F.lit(bins - 1)).alias("bin"), F.col(c).alias("v")
        )

    shared = _intervals(searches)
    counted = (
        _spread(values, list(shared), cell)
        .groupBy("at", "bin")
        .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .orderBy("at", "bin")
        .collect()  # at most one row per interval and bin
    )
    for i, group in enumerate(shared.values()):
        found = [r for r in counted if r["at"] == i]
        for s in group:
            below = s.below
            for row in found:
                if s.rank < below + row["n"]:
                    s.low, s.high, s.below, s.inside = row["lo"], row["hi"], below, row["n"]
                    break
                below += row["n"]


def _sort_inside(values: DataFrame, searches: Sequence[_Search]) -> None:
    """Read each rank off its interval's few sorted values."""
    if not searches:
        return
    shared = _intervals(searches)

    def cell(i: int, c: str, low: float, high: float) -> F.Column:
        return F.struct(F.lit(i).alias("at"), F.col(c).alias("v"))

    places = F.array(*[
        F.array(*[F.lit(s.rank - s.below + 1) for s in group]) for group in shared.values()
    ])
    few = _spread(values, list(shared), cell).groupBy("at").agg(
        F.sort_array(F.collect_list("v")).alias("vs")
    )
    rows = few.select(
        "at", F.transform(F.element_at(places, F.col("at") + 1), lambda i: F.element_at("vs", i)).alias("found")
    ).collect()
    groups = list(shared.values())
    for row in rows:
        for s, v in zip(groups[row["at"]], row["found"]):
            s.low = s.high = v


def quantile_table(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float] = (0.01, 0.99)
) -> DataFrame:
    """Quantiles as rows (column, prob, value)."""
    found = exact_quantiles(df, cols, probs)
    rows = [(c, float(p), v) for c in cols for p, v in zip(probs, found[c])]
    return df.sparkSession.createDataFrame(rows, "column string, prob double, value double")
