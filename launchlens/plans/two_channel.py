"""Web and stores together: from clean lines to models of sales after week three."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchlens import operators as op
from launchlens.functions import (
    SCHEME_WEEK3,
    age_bucket,
    age_days,
    month_name,
    relative_price,
    season_of,
    solid_flag,
    weighted_mean,
)
from launchlens.plans.common import Matrix, clustered, design_matrix, elbow, evaluate_fit, split_rows
from launchlens.plans.settings import TwoChannelSettings

DEFAULT = TwoChannelSettings()
WEEKS = ("1W", "2W", "3W")
TAGS = tuple(tag for tag, _ in SCHEME_WEEK3)
VALUES = ("totalsales", "units", "avg_margins", "avg_price")
FILLED = tuple(f"{v}_{t}" for v in VALUES for t in (*WEEKS, "2M", "3M"))
PROFILE_COLS = (
    "count_sku", "count_styles", "count_merchantclass", "totalsales", "units",
    "avg_margins", "avg_price",
)
OVERLAP_KEYS = ("channel", "merchant_class", "solid_flag", "pattern", "launch_date")
NUMERIC = (
    "totalsales_1W", "totalsales_2W", "totalsales_3W", "units_1W", "units_2W", "units_3W",
    "launched_1m", "launched_2m", "launched_3m", "avgprice", "relativeprice",
)
CATEGORICAL = ("channel", "merchant_class", "solid_flag", "cluster", "month")
IDS = ("pattern", "launch_date", "merchant_class", "month", "season")
#: Schemas of what training returns.
RESULTS = {
    "metrics": "model string, part string, rmse double, r2 double, mae double",
    "resampled": "fold int, rmse double, r2 double, mae double, model string",
    "forest_tuning": "candidate int, parameters string, rmse double, r2 double, mae double",
    "linear_importance": "variable string, importance double",
    "boosted_importance": "variable string, importance double",
}


def build_sku_daily(
    web: DataFrame, pos: DataFrame, skus: DataFrame, stores: DataFrame,
    s: TwoChannelSettings = DEFAULT,
) -> DataFrame:
    """Clean lines of both channels by channel, SKU and day, with launch and product columns.

    Lines are rolled up before any join, so joins see days and not lines.
    """
    web_days = op.with_launch(op.daily_rollup(web, op.WEB_SPEC), skus, "inner")
    # The launch looks at all stores' sales, so it comes before any is left out.
    store_days = op.with_launch(op.daily_rollup(pos, op.POS_SPEC, ["store"]), skus, "inner")
    store_days = op.exclude_values(store_days, "store", s.excluded_stores)
    by = ["sku", "district", "sale_date", "launch_date"]
    placed = op.enrich(store_days, stores, "store", ["district", "store_type"]).filter(F.col("store_type") == s.store_type)
    # Without the deal the sums would stay in the task that joined and sorted the SKU's days, with two tables of them.
    district_days = op.rollup_to(op.dealt(placed.select(*by, *op.MEASURES), *by), by)
    both = op.enrich_sku(
        op.combine_channels(web_days, district_days.drop("district")), skus, list(s.product_cols)
    )
    return op.exclude_values(both, "merchant_class", s.excluded_classes)


def focus(sku_daily: DataFrame, s: TwoChannelSettings = DEFAULT) -> DataFrame:
    """Seasons and launches under study, with solid flag and age bucket."""
    df = op.keep_values(sku_daily, "release_season", s.seasons)
    df = op.launched_between(df, low=s.launched_from)
    df = op.exclude_values(df, "style", s.excluded_styles)
    return df.withColumns({
        "solid_flag": solid_flag("color_family", "Non-Solid"),
        "group_tag": age_bucket(age_days("sale_date", "launch_date"), SCHEME_WEEK3),
    })


def early_profile(base: DataFrame, top: DataFrame) -> DataFrame:
    """How each top pattern did in its first three weeks."""
    return op.restrict_to(op.pattern_profile(op.first_buckets(base)), top)


def cluster_patterns(
    base: DataFrame, top: DataFrame, s: TwoChannelSettings = DEFAULT
) -> DataFrame:
    """Early profile of each top pattern with its k-means cluster and silhouette: nearest other cluster and width."""
    return clustered(early_profile(base, top), PROFILE_COLS, s.clusters, s.starts, s.max_iter, s.seed)


def pattern_elbow(base: DataFrame, top: DataFrame, s: TwoChannelSettings = DEFAULT) -> DataFrame:
    """Least k-means cost of the early profiles for each number of clusters: (k, cost)."""
    return elbow(early_profile(base, top), PROFILE_COLS, s.elbow_ks, s.elbow_starts, s.max_iter, s.seed)


def cannibalisation_metrics(base: DataFrame, top: DataFrame) -> DataFrame:
    """Recent launches around each launch of the top patterns, and what they then sold."""
    # Read twice, for the launches and for their neighbours' sales.
    days = op.materialize(op.pattern_daily(op.restrict_to(base, top)))
    return op.launch_overlap_metrics(days)


def wide_sales(base: DataFrame, top: DataFrame) -> DataFrame:
    """One row per channel, pattern, class, season, solid flag and launch; buckets as columns.

    The launch is a bucket's own minimum, so a pattern whose buckets disagree
    has several rows.
    """
    # Fixed value: this model spells the summer season in capitals.
    seasons = (("M", "SUMMER"), ("S", "Spring"), ("W", "Winter"), ("F", "Fall"))
    rows = op.model_aggregate(
        op.restrict_to(base, top).withColumn("season", season_of("release_season", seasons))
    )
    ids = ["channel", "pattern", "merchant_class", "season", "solid_flag", "launch_date"]
    return op.zero_fill(op.pivot_wide(rows, ids, "group_tag", TAGS, VALUES), FILLED)


def model_table(
    base: DataFrame, top: DataFrame, overlap: DataFrame, clusters: DataFrame,
    s: TwoChannelSettings = DEFAULT,
) -> DataFrame:
    """Target and features per launch, in original units."""
    df = op.add_cumulative(wide_sales(base, top), "cumulative_units", ["units_2M", "units_3M"])
    early_sales = F.col("totalsales_1W") + F.col("totalsales_2W") + F.col("totalsales_3W")
    df = df.filter(early_sales > 0).filter(F.col("cumulative_units") > 0)
    df = op.attach_features(df, overlap, OVERLAP_KEYS)
    df = op.attach_features(df, clusters.select("pattern", "cluster"), ["pattern"])
    df = df.withColumn(
        "avgprice", weighted_mean([(f"units_{w}", f"avg_price_{w}") for w in WEEKS])
    )
    existing = [f"existing_{n}_{m}" for n in op.WINDOWS for m in ("totalsales", "units", "avg_price")]
    launched = [f"launched_{n}" for n in op.WINDOWS]
    # Read twice, by the donor means and by the rows they go to.
    df = op.materialize(op.zero_fill(df, [*existing, *launched]))
    df = op.impute_early(df, ["channel", "merchant_class", "solid_flag"], s.impute)
    df = op.keep_values(df, "merchant_class", s.classes)
    df = op.drop_burst_only(df, "cumulative_units", [f"units_{w}" for w in WEEKS], s.burst_limit)
    df = df.withColumns({
        "relativeprice": relative_price("avgprice", "existing_3m_avg_price"),
        "month": month_name("launch_date"),
    })
    df = op.launched_between(df, high=s.launched_to)
    return df.select(
        "channel", "pattern", "merchant_class", "season", "solid_flag", "launch_date", "month",
        "cluster", "cumulative_units",
        *[F.col(c).cast("double").alias(c) for c in NUMERIC],
    )


def log_scale(table: DataFrame, s: TwoChannelSettings = DEFAULT) -> DataFrame:
    """Logs of sales and units, and of the target."""
    early = [f"{v}_{w}" for v in ("totalsales", "units") for w in WEEKS]
    table = op.log_transform(table, early, s.log_offset)
    return op.log_transform(table, ["cumulative_units"])


def matrix(table: DataFrame, s: TwoChannelSettings = DEFAULT) -> Matrix:
    """Dummies and a full-rank set of features, on the log scale."""
    return design_matrix(
        log_scale(table, s), "cumulative_units", NUMERIC, CATEGORICAL, IDS
    )


def train_all(
    m: Matrix,
    s: TwoChannelSettings = DEFAULT,
    boosted: dict[str, object] | None = None,
    candidates: list[int] | None = None,
) -> dict[str, DataFrame]:
    """Linear, forest, boosted and bagged models: metrics, held-out metrics by fold, the forest's tuning table, importances.

    A matrix without rows or features has nothing to fit, and all of these are empty.
    """
    if not m.xs or m.df.isEmpty():
        return {name: m.df.sparkSession.createDataFrame([], schema) for name, schema in RESULTS.items()}
    rows = split_rows(m, s.train_share, s.folds, s.seed)
    train = rows.filter("is_train")
    linear = op.fit_linear(train, m.y, m.xs, fold="fold")
    forest = op.fit_forest(train, m.y, m.xs, "fold", s.forest_trees, candidates=candidates, seed=s.seed)
    boost = op.fit_boosted(train, m.y, m.xs, boosted or op.BOOSTED, "fold", s.seed)
    bagged = op.fit_bagged(train, m.y, m.xs, "fold", seed=s.seed)
    fits = (("linear", linear), ("forest", forest), ("boosted", boost), ("bagged", bagged))
    scored = [evaluate_fit(fit.predict(rows) if label == "linear" else fit.transform(rows), m.y, label) for label, fit in fits]
    held = [fit.resampled.select("fold", "rmse", "r2", "mae").withColumn("model", F.lit(label)) for label, fit in fits]
    return {
        "metrics": reduce(DataFrame.unionByName, scored),
        "resampled": reduce(DataFrame.unionByName, held),
        "forest_tuning": forest.tuning,
        "linear_importance": op.importance(rows, linear, top=15),
        "boosted_importance": op.importance(rows, boost, m.xs, top=20),
    }


def run(
    web: DataFrame, pos: DataFrame, skus: DataFrame, stores: DataFrame,
    s: TwoChannelSettings = DEFAULT, **train: object,
) -> dict[str, DataFrame]:
    """The whole workflow from clean lines to model metrics."""
    base = op.materialize(focus(build_sku_daily(web, pos, skus, stores, s), s))
    top = op.materialize(op.top_patterns(base, s.n_patterns))
    clusters = op.materialize(cluster_patterns(base, top, s))
    overlap = cannibalisation_metrics(base, top)
    table = model_table(base, top, overlap, clusters, s)
    found = train_all(matrix(table, s), s, **train)
    return {**found, "clusters": clusters, "elbow": pattern_elbow(base, top, s)}
