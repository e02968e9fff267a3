"""Rollups of sales lines, enrichment from the masters, and pattern aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from launchlens.functions import (
    effective_launch,
    exact_sum,
    line_margin,
    line_value,
    ratio_of_sums,
)
from launchlens.operators.shape import align_to, dealt, tag_channel

__all__ = [
    "MEASURES",
    "POS_SPEC",
    "SalesSpec",
    "WEB_SPEC",
    "append_channels",
    "attach_color_family",
    "attach_features",
    "bucket_rollup",
    "combine_channels",
    "daily_rollup",
    "enrich",
    "enrich_sku",
    "enrich_sku_store",
    "first_launch",
    "first_sale",
    "launch_dates",
    "model_aggregate",
    "model_aggregate_pos",
    "pattern_counts",
    "pattern_daily",
    "pattern_district_profile",
    "pattern_profile",
    "restrict_to",
    "rollup_to",
    "top_patterns",
    "with_launch",
]

MEASURES = ("totalsales", "trans", "units", "margins", "price")


@dataclass(frozen=True)
class SalesSpec:
    """Which columns of a sales frame play which part."""

    sku: str
    date: str
    slip: str
    amount: str
    quantity: str
    cost: str
    list_price: str


WEB_SPEC = SalesSpec(
    sku="sku", date="order_date", slip="order_number", amount="amount",
    quantity="confirmed_quantity", cost="standard_cost", list_price="retail_price",
)
POS_SPEC = SalesSpec(
    sku="sku", date="sale_date", slip="slip", amount="net_sale_amount",
    quantity="sale_quantity", cost="standard_cost", list_price="retail_price",
)


# --- lines to days ---------------------------------------------------------------

def daily_rollup(
    lines: DataFrame,
    spec: SalesSpec,
    keys: Sequence[str] = (),
    discount_flag: Column | None = None,
) -> DataFrame:
    """Sales lines by SKU, day and any further keys, optionally split by a discount flag.

    ``trans`` counts distinct slips inside one row of the result. Later rollups
    add it up, so from there on it is a number of slip-days and not of slips.
    """
    by: list[Column] = [F.col(spec.sku).alias("sku"), *[F.col(k) for k in keys],
                        F.col(spec.date).alias("sale_date")]
    if discount_flag is not None:
        by.append(discount_flag.alias("discount_flag"))
    return lines.groupBy(*by).agg(
        exact_sum(spec.amount).alias("totalsales"),
        F.count_distinct(spec.slip).alias("trans"),
        exact_sum(spec.quantity).alias("units"),
        exact_sum(line_margin(spec.amount, spec.cost)).alias("margins"),
        exact_sum(line_value(spec.list_price, spec.quantity)).alias("price"),
    )


def first_sale(df: DataFrame, sku: str = "sku", date: str = "sale_date") -> DataFrame:
    return df.groupBy(sku).agg(F.min(date).alias("first_sale"))


def launch_dates(
    sales: DataFrame, skus: DataFrame, how: str = "left", sku: str = "sku", date: str = "sale_date"
) -> DataFrame:
    """One effective launch date per SKU sold.

    ``how`` decides on SKUs missing from the master: ``left`` launches them on
    their first sale, ``inner`` leaves them out.
    """
    master = skus.select(F.col("sku").alias(sku), F.col("launch_date").alias("_master"))
    return (
        first_sale(sales, sku, date)
        .join(master, sku, how)
        .select(sku, effective_launch("_master", "first_sale").alias("launch_date"))
    )


def with_launch(days: DataFrame, skus: DataFrame, how: str = "left") -> DataFrame:
    """Rolled-up rows with the effective launch date of their SKU.

    The first sale is a grouped minimum, combined before it is shuffled, and the
    launch dates, one row per SKU, are joined back. No task sorts or holds the days
    of a SKU, however many stores sell it. A row without a SKU has no launch.
    """
    return days.join(launch_dates(days, skus, how), "sku", how)


def _sum_measures(df: DataFrame, keys: Sequence[str | Column], *first: Column) -> DataFrame:
    sums = [
        (F.sum(m) if m == "trans" else exact_sum(m)).alias(m) for m in MEASURES
    ]
    return df.groupBy(*keys).agg(*first, *sums)


def rollup_to(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the five daily measures up to coarser keys."""
    return _sum_measures(df, keys)


def bucket_rollup(
    df: DataFrame, keys: Sequence[str] = ("sku", "launch_date", "discount_flag"),
    tag: str = "group_tag",
) -> DataFrame:
    """Daily rows added up to age buckets."""
    return _sum_measures(dealt(df, *keys, tag), [*keys, tag])


def combine_channels(web: DataFrame, pos: DataFrame) -> DataFrame:
    """Channel, SKU and day over both channels, with the earliest launch.

    Web rows need a positive SKU key, rows of both a positive list value.
    """
    both = tag_channel(web.filter(F.col("sku") > 0), "Web").unionByName(
        tag_channel(pos, "Pos"), allowMissingColumns=True
    )
    keys = ["channel", "sku", "sale_date"]
    return _sum_measures(
        dealt(both.filter(F.col("price") > 0), *keys), keys,
        F.min("launch_date").alias("launch_date"),
    )


def append_channels(web: DataFrame, pos: DataFrame, distinct: bool = True) -> DataFrame:
    """Rows of both channels under one schema; columns of one side only are NULL on the other.

    With ``distinct``, equal aggregate rows collapse, as in a SQL ``UNION``.
    """
    names = [f.name for f in web.schema.fields]
    extra = [f for f in pos.schema.fields if f.name not in names]
    schema = reduce(lambda s, f: s.add(f), extra, type(web.schema)(list(web.schema.fields)))
    both = align_to(web, schema).union(align_to(pos, schema))
    return both.distinct() if distinct else both


# --- joins to masters and lists -----------------------------------------------------

def enrich(
    df: DataFrame, dim: DataFrame, key: str, cols: Sequence[str], how: str = "left"
) -> DataFrame:
    """Columns of a master by one key."""
    return df.join(dim.select(key, *cols), key, how)


def enrich_sku(
    df: DataFrame, skus: DataFrame, cols: Sequence[str], how: str = "inner"
) -> DataFrame:
    return enrich(df, skus, "sku", cols, how)


def enrich_sku_store(
    df: DataFrame,
    skus: DataFrame,
    stores: DataFrame,
    sku_cols: Sequence[str],
    store_cols: Sequence[str],
    store_type: str | None = "Full Line",
) -> DataFrame:
    """Product and store columns, then one store type only.

    Both joins are left joins; the filter on the store type makes the second an
    inner one, which the optimizer does by itself.
    """
    out = enrich(df, skus, "sku", sku_cols)
    out = enrich(out, stores, "store", [*store_cols, "store_type"])
    if store_type is not None:
        out = out.filter(F.col("store_type") == store_type)
    return out.drop("store_type")


def restrict_to(
    df: DataFrame, keys: DataFrame, on: str = "pattern", distinct_keys: bool = True
) -> DataFrame:
    """Rows whose key is in a list; a list with repeats repeats the rows."""
    return df.join(keys.select(on), on, "left_semi" if distinct_keys else "inner")


def attach_features(
    df: DataFrame, feats: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Feature columns by a composite key."""
    return df.join(feats, list(keys), how)


def attach_color_family(
    df: DataFrame, skus: DataFrame, keys: Sequence[str] = ("pattern", "merchant_class")
) -> DataFrame:
    """Color family by pattern and class; a pair with two families gives two rows."""
    families = skus.select(*keys, "color_family").distinct()
    return df.join(families, list(keys), "left").distinct()


# --- patterns --------------------------------------------------------------------------

def top_patterns(df: DataFrame, n: int = 150) -> DataFrame:
    """The n patterns with the highest sales; ties go to the first name."""
    return (
        df.groupBy("pattern")
        .agg(exact_sum("totalsales").alias("totalsales"))
        .orderBy(F.desc("totalsales"), F.asc("pattern"))
        .limit(n)
    )


def _partial_sums() -> list[Column]:
    return [exact_sum(m).alias(m) for m in ("totalsales", "units", "margins", "price")]


def pattern_profile(df: DataFrame) -> DataFrame:
    """One row per pattern: distinct SKUs, styles, classes; sums and ratios of sums.

    Sums go to SKU level first, so the distinct counts (which multiply their
    input rows) see one row per SKU and not one per SKU and day.
    """
    per_sku = df.groupBy("pattern", "sku", "style", "merchant_class").agg(*_partial_sums())
    return per_sku.groupBy("pattern").agg(
        F.count_distinct("sku").alias("count_sku"),
        F.count_distinct("style").alias("count_styles"),
        F.count_distinct("merchant_class").alias("count_merchantclass"),
        exact_sum("totalsales").alias("totalsales"),
        exact_sum("units").alias("units"),
        exact_sum("margins").alias("total_margins"),
        ratio_of_sums("margins", "units").alias("avg_margins"),
        ratio_of_sums("price", "units").alias("avg_price"),
    )


def pattern_district_profile(df: DataFrame, districts: Sequence[str]) -> DataFrame:
    """Pattern and district: distinct classes, SKUs, styles, stores; sums; mean price."""
    per_sku = (
        df.filter(F.col("district").isin(*districts))
        .groupBy("pattern", "district", "sku", "style", "merchant_class", "store")
        .agg(*_partial_sums())
    )
    return per_sku.groupBy("pattern", "district").agg(
        F.count_distinct("merchant_class").alias("count_merchant_class"),
        F.count_distinct("sku").alias("count_sku"),
        F.count_distinct("style").alias("count_styles"),
        F.count_distinct("store").alias("count_stores"),
        exact_sum("totalsales").alias("totalsales"),
        exact_sum("units").alias("units"),
        exact_sum("margins").alias("margins"),
        ratio_of_sums("price", "units").alias("avg_price"),
    )


def pattern_counts(
    df: DataFrame, cols: Sequence[str] = ("count_merchant_class", "count_sku", "count_styles")
) -> DataFrame:
    """Per-district distinct counts added up by pattern (so not distinct any more)."""
    return df.groupBy("pattern").agg(*[F.sum(c).alias(c) for c in cols])


def first_launch(
    df: DataFrame, keys: Sequence[str] = ("pattern", "merchant_class")
) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("launch_date").alias("launch_date"))


def pattern_daily(df: DataFrame) -> DataFrame:
    """Channel, pattern, class, solid flag and day, with one launch per channel, pattern, class.

    The launch is the minimum over the grouped rows' minima. The window sees one
    row per group and day, never sales lines.
    """
    days = df.groupBy("channel", "pattern", "merchant_class", "solid_flag", "sale_date").agg(
        F.min("launch_date").alias("_first"), *_partial_sums()
    )
    w = Window.partitionBy("pattern", "merchant_class", "channel")
    return days.withColumn("launch_date", F.min("_first").over(w)).drop("_first")


def model_aggregate(df: DataFrame) -> DataFrame:
    """Channel, pattern, class, season, solid flag and age bucket.

    ``launch_date`` is the minimum inside each bucket, so it may differ between
    the buckets of one pattern.
    """
    return df.groupBy(
        "channel", "pattern", "merchant_class", "season", "solid_flag", "group_tag"
    ).agg(
        F.min("launch_date").alias("launch_date"),
        exact_sum("totalsales").alias("totalsales"),
        exact_sum("units").alias("units"),
        ratio_of_sums("margins", "units").alias("avg_margins"),
        ratio_of_sums("price", "units").alias("avg_price"),
    )


def model_aggregate_pos(df: DataFrame, clusters: DataFrame) -> DataFrame:
    """District, pattern, class, cluster and age bucket; patterns without a cluster stay."""
    per_sku = df.groupBy(
        "district", "pattern", "merchant_class", "group_tag", "style", "store"
    ).agg(*_partial_sums())
    joined = per_sku.join(clusters.select("pattern", "cluster"), "pattern", "left")
    return joined.groupBy(
        "district", "pattern", "merchant_class", "cluster", "group_tag"
    ).agg(
        exact_sum("totalsales").alias("totalsales"),
        exact_sum("units").alias("units"),
        exact_sum("margins").alias("margins"),
        ratio_of_sums("price", "units").alias("avg_price"),
        F.count_distinct("style").alias("count_styles"),
        F.count_distinct("store").alias("count_stores"),
    )
