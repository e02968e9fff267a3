"""Cannibalisation: which other launches fall near a launch, and what they sell.

Both operators are range self joins by definition. Neither joins: a launch's
answer depends on its group and its date only, so the other side is aggregated
per group and date first, and each launch then looks its own date up.

Contract of the metrics: a pattern has one launch date per group key
(``pattern_daily`` sees to that). A window that leaves out day 0 then never
holds the pattern itself, which is what makes the lookup by date exact. The counts
also take patterns with several launch dates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from launchlens.functions import age_days, date_to_epoch_days, exact_sum

__all__ = ["BANDS", "WINDOWS", "launch_overlap_counts", "launch_overlap_metrics"]

# Launch bands in days before a launch (both ends count), and windows back.
BANDS = {"1m": (-30, -1), "2m": (-60, -30), "3m": (-90, -60)}
WINDOWS = {"1m": 30, "2m": 60, "3m": 90}


def launch_overlap_counts(
    launches: DataFrame,
    bands: Mapping[str, tuple[int, int]] = BANDS,
    group: Sequence[str] = ("merchant_class",),
    pattern: str = "pattern",
    launch: str = "launch_date",
) -> DataFrame:
    """Number of other patterns of the group launched inside each band before a launch.

    A pattern may have launched on several dates; it counts once for a band, and
    never for its own launches. Its launch on day l is its first inside the band
    ``[d + low, d + high]`` for the days d from ``l - high``, or from the day after
    ``previous launch - low`` if that is later, to ``l - low``. These stretches are begun and
    ended in daily sums, so a window partition holds at most a few rows per
    calendar day however many patterns a group has.
    """
    if any(low <= 0 <= high for low, high in bands.values()):
        raise ValueError("a band must leave out day 0, the launch itself")
    day = date_to_epoch_days(launch)
    own = Window.partitionBy(*group, pattern).orderBy("_l")
    dates = launches.filter(F.col(pattern).isNotNull() & F.col(launch).isNotNull()).select(
        *group, pattern, day.alias("_l")).distinct().withColumn("_before", F.lag("_l").over(own))
    steps, names = [], []
    for name, (low, high) in bands.items():
        begin = F.greatest(F.col("_l") - high, F.col("_before") - low + 1)
        end = F.col("_l") - low + 1
        steps += [F.struct(F.when(begin < end, d).alias("_d"), F.lit(name).alias("_band"), F.lit(n).alias("_n")) for d, n in ((begin, 1), (end, -1))]
        names.append(name)
    changes = dates.select(*group, F.explode(F.array(*steps)).alias("_s")).select(*group, "_s.*").filter("_d is not null")
    asked = dates.select(*group, F.col("_l").alias("_d")).distinct()
    daily = changes.groupBy(*group, "_d").agg(*[
        F.sum(F.when(F.col("_band") == n, F.col("_n")).otherwise(0)).alias(f"_{n}") for n in names])
    every = daily.unionByName(asked.select(*group, "_d", *[F.lit(0).cast("long").alias(f"_{n}") for n in names])).groupBy(*group, "_d").agg(
        *[F.sum(f"_{n}").alias(f"_{n}") for n in names])
    so_far = Window.partitionBy(*group).orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    counts = every.select(*group, "_d", *[F.sum(f"_{n}").over(so_far).alias(f"_{n}") for n in names])
    within = {n: F.count("_l").over(own.rangeBetween(*bands[n])) > 0 for n in names}
    mine = dates.select(*group, pattern, F.col("_l").alias("_d"), *[c.cast("int").alias(f"_own_{n}") for n, c in within.items()])
    # a launch without a pattern, group key or date compares to nothing
    return (
        launches.withColumn("_d", day)
        .join(counts, [*group, "_d"], "left").join(mine, [*group, pattern, "_d"], "left")
        .select(*launches.columns, *[
            F.coalesce(F.when(F.col(pattern).isNotNull(), F.col(f"_{n}") - F.col(f"_own_{n}")), F.lit(0)).alias(f"existing_{n}") for n in names])
    )


def launch_overlap_metrics(
    daily: DataFrame,
    windows: Mapping[str, int] = WINDOWS,
    horizon: int = 21,
    group: Sequence[str] = ("channel", "merchant_class", "solid_flag"),
    pattern: str = "pattern",
    launch: str = "launch_date",
    sale_date: str = "sale_date",
) -> DataFrame:
    """Other patterns launched in the days before a launch, and their sales just after it.

    For each launch date d of a group and each window of N days: the patterns
    launched in [d-N, d-1] that sold in [d, d+horizon], and the sums over those
    sales. Read from the sale's side, a sale on day s of a pattern launched on
    day l counts for the dates d in [max(l+1, s-horizon), min(l+N, s)], at most
    horizon+1 of them. Each daily row is spread over these dates and added up
    per group and date: a constant factor, no join, combined before the shuffle.
    A pattern is counted for d at its first sale on or after d, so distinct
    counts need no distinct.
    """
    widest = max(windows.values())
    age = age_days(sale_date, launch)
    # A sale more than widest+horizon days after its launch is in no window.
    sales = daily.filter(
        F.col(pattern).isNotNull() & age.between(1, widest + horizon)
    )
    before = F.lag(sale_date).over(
        Window.partitionBy(*group, pattern, launch).orderBy(sale_date)
    )
    first_day = F.greatest(F.date_add(launch, 1), F.date_sub(sale_date, horizon))
    last_day = F.least(F.date_add(launch, widest), F.col(sale_date))
    spread = (
        sales.withColumn("_before", before)
        .filter(first_day <= last_day)
        .select(
            *group, launch, "_before", "totalsales", "units", "margins",
            F.explode(F.sequence(first_day, last_day)).alias("_day"),
        )
        .withColumn("_gap", F.datediff("_day", F.col(launch)))
        .withColumn("_new", F.col("_before").isNull() | (F.col("_day") > F.col("_before")))
    )
    sums, columns = [], []
    for name, days in windows.items():
        inside = F.col("_gap") <= days
        sums.append(F.count_if(inside & F.col("_new")).alias(f"launched_{name}"))
        for m in ("totalsales", "units", "margins"):
            sums.append(exact_sum(F.when(inside, F.col(m))).alias(f"_{m}_{name}"))
        columns += [
            F.coalesce(f"launched_{name}", F.lit(0)).alias(f"launched_{name}"),
            F.col(f"_totalsales_{name}").alias(f"existing_{name}_totalsales"),
            F.col(f"_units_{name}").alias(f"existing_{name}_units"),
            F.try_divide(f"_margins_{name}", f"_units_{name}").alias(f"existing_{name}_avgmargins"),
            F.try_divide(f"_totalsales_{name}", f"_units_{name}").alias(f"existing_{name}_avg_price"),
        ]
    per_day = spread.groupBy(*group, F.col("_day").alias(launch)).agg(*sums)
    keys = daily.select(*group, pattern, launch).distinct().alias("k")
    # A NULL pattern is no different from any other, so it must find nothing.
    same = F.col(f"k.{pattern}").isNotNull()
    for c in (*group, launch):
        same = same & (F.col(f"k.{c}") == F.col(f"p.{c}"))
    out = keys.join(per_day.alias("p"), same, "left")
    return out.select(*[F.col(f"k.{c}") for c in (*group, pattern, launch)], *columns)
