"""Stores by district: from clean lines to linear models of sales after week three."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchlens import operators as op
from launchlens.functions import (
    SCHEME_WEEK4,
    age_bucket,
    age_days,
    month_name,
    pos_discount_flag,
    recode,
    season_of,
    solid_flag,
    web_discount_flag,
)
from launchlens.plans.common import Matrix, clustered, design_matrix, elbow, evaluate_fit, split_rows
from launchlens.plans.settings import StoreSettings

DEFAULT = StoreSettings()
WEEKS = ("1W", "2W", "3W")
TAGS = tuple(tag for tag, _ in SCHEME_WEEK4)
DISTRICT_VALUES = ("totalsales", "units", "margins", "avg_price", "count_stores")
COUNTS = ("count_merchant_class", "count_sku", "count_styles")
VALUES = ("totalsales", "units", "margins", "avg_price", "count_styles", "count_stores")
FILLED = (
    *[f"{v}_{w}" for v in VALUES for w in WEEKS], "units_4W", "units_2M", "units_3M",
)
NUMERIC = (
    "three_week_sales", "units_1W", "units_2W", "units_3W", "avg_price_1W", "avg_price_2W",
    "avg_price_3W", "three_week_margins", "three_week_stores", "three_week_styles",
    "existing_1m", "existing_2m", "existing_3m",
)
CATEGORICAL = ("district", "cluster", "merchant_class", "month", "solid_flag")
TARGET = "cumulative_units"


def build_bucketed(
    web: DataFrame, pos: DataFrame, skus: DataFrame, stores: DataFrame, s: StoreSettings = DEFAULT
) -> tuple[DataFrame, DataFrame]:
    """Web and store sales by SKU (and store), discount flag and age bucket, with master columns."""
    def aged(days: DataFrame) -> DataFrame:
        return op.with_launch(days, skus).withColumn(
            "group_tag", age_bucket(age_days("sale_date", "launch_date"), SCHEME_WEEK4)
        )

    web_days = op.daily_rollup(web, op.WEB_SPEC, discount_flag=web_discount_flag("web_discount"))
    web_buckets = op.bucket_rollup(aged(web_days), ["sku", "launch_date", "discount_flag"])
    web_final = op.exclude_values(
        op.enrich_sku(web_buckets, skus, list(s.product_cols), "left"),
        "department", s.excluded_departments,
    )
    pos_days = op.daily_rollup(
        pos, op.POS_SPEC, ["store"], pos_discount_flag("sale_discount", "misc_discount")
    )
    pos_buckets = op.bucket_rollup(aged(pos_days), ["sku", "store", "launch_date", "discount_flag"])
    pos_final = op.enrich_sku_store(
        pos_buckets, skus, stores, list(s.product_cols), list(s.store_cols), s.store_type
    )
    return web_final, pos_final


def build_pattern_base(
    web_final: DataFrame, pos_final: DataFrame, skus: DataFrame, top: DataFrame,
    s: StoreSettings = DEFAULT,
) -> DataFrame:
    """Both channels appended, of the seasons and launches under study and the listed patterns.

    The list may hold a pattern twice, which then counts twice.
    """
    def studied(df: DataFrame, channel: str) -> DataFrame:
        df = op.keep_values(df, "release_season", s.seasons)
        df = op.launched_between(df, low=s.launched_from)
        return op.tag_channel(df, channel)

    pos_kept = op.exclude_values(pos_final, "store", s.excluded_stores)
    web_cols = [c for c in s.append_cols if c == "channel" or c in web_final.columns]
    pos_cols = [c for c in s.append_cols if c == "channel" or c in pos_final.columns]
    both = op.append_channels(
        studied(web_final, "WEB").select(*web_cols), studied(pos_kept, "POS").select(*pos_cols)
    )
    both = op.enrich_sku(both, skus, ["merchant_class"], "left")
    both = op.restrict_to(both, top, distinct_keys=False)
    return both.withColumn("season", season_of("release_season"))


def model_stores(base: DataFrame, s: StoreSettings = DEFAULT) -> DataFrame:
    """Store rows of the classes under study, outside the excluded districts."""
    df = op.exclude_values(base, "district", s.excluded_districts)
    return op.keep_values(df, "merchant_class", s.classes).filter(F.col("channel") == "POS")


def district_profile(
    stores_base: DataFrame, stores: DataFrame, s: StoreSettings = DEFAULT
) -> DataFrame:
    """One row per pattern: five measures by district, and three counts over districts."""
    rows = op.enrich(stores_base, stores, "store", ["state"])
    rows = op.launched_between(op.first_buckets(rows), high=s.cluster_launched_to)
    # Read twice, by the counts and by the pivot.
    profile = op.materialize(op.pattern_district_profile(rows, s.districts))
    counts = op.pattern_counts(profile)
    # Names of columns to be, so without blanks.
    short = {d: d.replace(" ", "") for d in s.districts if " " in d}
    measures = op.zero_fill(
        profile.drop(*COUNTS).withColumn("district", recode("district", short)),
        ["totalsales", "margins", "units", "avg_price"],
    )
    names = [short.get(d, d) for d in s.districts]
    wide = op.pivot_wide(measures, ["pattern"], "district", names, DISTRICT_VALUES)
    wide = op.zero_fill(wide, [f"{v}_{d}" for v in DISTRICT_VALUES for d in names])
    joined = op.attach_features(wide, counts, ["pattern"], "inner")
    return op.exclude_values(joined, "pattern", s.cluster_excluded)


def cluster_patterns_by_district(
    stores_base: DataFrame, stores: DataFrame, s: StoreSettings = DEFAULT
) -> DataFrame:
    """District profile of each pattern with its k-means cluster and silhouette: nearest other cluster and width."""
    profile = district_profile(stores_base, stores, s)
    return clustered(profile, [c for c in profile.columns if c != "pattern"], s.clusters, s.starts, s.max_iter, s.seed)


def district_elbow(stores_base: DataFrame, stores: DataFrame, s: StoreSettings = DEFAULT) -> DataFrame:
    """Least k-means cost of the district profiles for each number of clusters: (k, cost)."""
    profile = district_profile(stores_base, stores, s)
    return elbow(profile, [c for c in profile.columns if c != "pattern"], s.elbow_ks, s.elbow_starts, s.max_iter, s.seed)


def pattern_launches(base: DataFrame, s: StoreSettings = DEFAULT) -> DataFrame:
    """Earliest launch per pattern and class in the districts kept; rows without a district go too."""
    df = op.exclude_values(base, "district", s.excluded_districts)
    return op.first_launch(op.keep_values(df, "merchant_class", s.classes))


def cannibalisation_counts(launches: DataFrame) -> DataFrame:
    """Other patterns of the class launched one, two and three months before each launch."""
    return op.launch_overlap_counts(launches)


def wide_sales(stores_base: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row per district, class, pattern and cluster; buckets as columns, and their sums."""
    rows = op.model_aggregate_pos(stores_base, clusters)
    ids = ["district", "merchant_class", "pattern", "cluster"]
    df = op.zero_fill(op.pivot_wide(rows, ids, "group_tag", TAGS, VALUES), FILLED)
    df = op.add_cumulative(df, TARGET, ["units_4W", "units_2M", "units_3M"])
    for name, value in (("sales", "totalsales"), ("styles", "count_styles"),
                        ("stores", "count_stores"), ("margins", "margins")):
        df = op.add_cumulative(df, f"three_week_{name}", [f"{value}_{w}" for w in WEEKS])
    return df


def model_table_pos(
    stores_base: DataFrame, launches: DataFrame, clusters: DataFrame, skus: DataFrame,
    s: StoreSettings = DEFAULT,
) -> DataFrame:
    """Target and features per district, class and pattern, in original units."""
    counts = cannibalisation_counts(launches).withColumn("month", month_name("launch_date"))
    df = op.attach_features(
        wide_sales(stores_base, clusters), counts.drop("launch_date"), ["pattern", "merchant_class"]
    )
    df = df.select("district", "pattern", "cluster", "merchant_class", "month", TARGET, *NUMERIC)
    df = op.require_non_negative(df, [
        "units_3W", "units_2W", "units_1W", "three_week_sales", TARGET, "three_week_margins",
    ])
    df = op.exclude_values(df, "pattern", s.model_excluded)
    df = op.attach_color_family(df, skus)
    return df.withColumn("solid_flag", solid_flag("color_family", "FloralPattern")).drop("color_family")


def tame(table: DataFrame, s: StoreSettings = DEFAULT) -> DataFrame:
    """Logs, tails clamped to the quantiles of all rows, then clustered patterns only."""
    logged = op.materialize(op.log_transform(table, [TARGET, *NUMERIC], s.log_offset))
    return op.winsorize(logged, [TARGET, *NUMERIC], *s.tails).filter(F.col("cluster").isNotNull())


def matrix(table: DataFrame, s: StoreSettings = DEFAULT) -> Matrix:
    """Dummies and a full-rank set of features, on the log scale."""
    return design_matrix(tame(table, s), TARGET, NUMERIC, CATEGORICAL, ["pattern", *CATEGORICAL])


def train_linear_family(m: Matrix, s: StoreSettings = DEFAULT) -> dict[str, DataFrame]:
    """Least squares, lasso and backward elimination: metrics, resampling and importance."""
    rows = split_rows(m, s.train_share, s.folds, s.seed)
    train = rows.filter("is_train")
    linear = op.fit_linear(train, m.y, m.xs, fold="fold")
    lasso = op.fit_lasso(train, m.y, m.xs, "fold", s.lasso_fractions)
    step = op.fit_step_aic(train, m.y, m.xs, "fold")
    fits = (("linear", linear), ("lasso", lasso), ("step_aic", step))
    metrics = [evaluate_fit(fit.predict(rows), m.y, label) for label, fit in fits]
    resampled = [
        fit.resampled.withColumn("model", F.lit(label)) for label, fit in fits
    ]
    return {
        "metrics": reduce(DataFrame.unionByName, metrics),
        "resampled": reduce(DataFrame.unionByName, resampled),
        "importance": op.importance(rows, linear),
    }


def run(
    web: DataFrame, pos: DataFrame, skus: DataFrame, stores: DataFrame, top: DataFrame,
    s: StoreSettings = DEFAULT,
) -> dict[str, DataFrame]:
    """The whole workflow from clean lines to model metrics."""
    web_final, pos_final = build_bucketed(web, pos, skus, stores, s)
    base = op.materialize(build_pattern_base(web_final, pos_final, skus, top, s))
    stores_base = model_stores(base, s)
    clusters = op.materialize(cluster_patterns_by_district(stores_base, stores, s))
    launches = op.materialize(pattern_launches(base, s))
    table = model_table_pos(stores_base, launches, clusters, skus, s)
    found = train_linear_family(matrix(table, s), s)
    return {**found, "clusters": clusters, "elbow": district_elbow(stores_base, stores, s)}
