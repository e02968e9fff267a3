"""Queries: scalar functions and reshapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import relational as rel
from catalog import views as v
from catalog.registry import query, r6, rounded
from catalog.views import SEASON_SQL, with_views
from launchlens import functions as fn
from launchlens import operators as op


@query("x1_effective_launch", with_views("select sku, launch_date from launches", "launches"))
def _(spark, root):
    return op.launch_dates(v.clean(spark, root), v.skus(spark, root), "inner")


@query("x2_age_days", with_views("""
    select l_orderkey, l_linenumber, cast(cast(o_orderdate as date) - cast(l_shipdate as date) as int) as days
    from lineitem join orders on l_orderkey = o_orderkey"""))
def _(spark, root):
    lines = v.load_table(spark, "lineitem", root, ["l_orderkey", "l_linenumber", "l_shipdate"])
    orders = v.load_table(spark, "orders", root, ["o_orderkey", "o_orderdate"])
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber",
        fn.age_days(F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")).alias("days"))


def bucket_sql(scheme) -> str:
    # Ages on both sides of 0, from an order date against a ship date.
    tag = v.bucket_tag_sql("days", scheme)
    return f"""
      select l_orderkey, days, {tag} as group_tag from (
        select l_orderkey, cast(cast(o_orderdate as date) - cast(l_shipdate as date) as int) as days
        from lineitem join orders on l_orderkey = o_orderkey)"""


def bucketed(spark, root, scheme):
    lines = v.load_table(spark, "lineitem", root, ["l_orderkey", "l_shipdate"])
    orders = v.load_table(spark, "orders", root, ["o_orderkey", "o_orderdate"])
    days = fn.age_days(F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date"))
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select("l_orderkey", days.alias("days"))
        .withColumn("group_tag", fn.age_bucket("days", scheme))
    )


@query("x3_age_bucket_week4", bucket_sql(fn.SCHEME_WEEK4))
def _(spark, root):
    return bucketed(spark, root, fn.SCHEME_WEEK4)


@query("x4_age_bucket_week3", bucket_sql(fn.SCHEME_WEEK3))
def _(spark, root):
    return bucketed(spark, root, fn.SCHEME_WEEK3)


@query("x5_web_discount_flag", with_views(
    f"select order_number, web_discount, {rel.WEB_FLAG} as flag from web", "web"))
def _(spark, root):
    return v.web(spark, root).select(
        "order_number", "web_discount", fn.web_discount_flag("web_discount").alias("flag"))


@query("x6_pos_discount_flag", with_views(
    f"select slip, sale_discount, misc_discount, {rel.POS_FLAG} as flag from pos", "pos"))
def _(spark, root):
    return v.pos(spark, root).select(
        "slip", "sale_discount", "misc_discount",
        fn.pos_discount_flag("sale_discount", "misc_discount").alias("flag"))


@query("x7_season_of", with_views(
    f"select sku, season_code, {SEASON_SQL.format(c='season_code')} as season from skus", "skus"))
def _(spark, root):
    return v.skus(spark, root).select("sku", "season_code", fn.season_of("season_code").alias("season"))


@query("x8_solid_flag", with_views("""
    select sku, color_family, case when color_family = 'Solid' then 'Solid' else 'FloralPattern' end as flag
    from skus""", "skus"))
def _(spark, root):
    return v.skus(spark, root).select(
        "sku", "color_family", fn.solid_flag("color_family", "FloralPattern").alias("flag"))


@query("x9_month_name", with_views(
    "select sku, launch_date, monthname(launch_date) as month from launches", "launches"))
def _(spark, root):
    launches = op.launch_dates(v.clean(spark, root), v.skus(spark, root), "inner")
    return launches.withColumn("month", fn.month_name("launch_date"))


@query("x10_recode", with_views("""
    select store, case when district = 'MIDDLE EAST' then 'MIDDLEEAST' else district end as district
    from stores""", "stores"))
def _(spark, root):
    return v.stores(spark, root).select("store", fn.recode("district", rel.SHORT).alias("district"))


FILLED = [f"{val}_{t}" for val in rel.VALUES9 for t in ("1W", "2W", "3W", "2M", "3M")]
FILL_SQL = ", ".join(f'coalesce("{c}", 0) as "{c}"' for c in FILLED)


@query("x11_zero_fill", with_views(f"select * replace ({FILL_SQL}) from ({rel.WIDE_SQL})", "sku_daily"))
def _(spark, root):
    return op.zero_fill(rel.wide9(spark, root), FILLED)


@query("x12_null_label", with_views(
    "select sku, coalesce(color_family, 'FloralPattern') as family from skus", "skus"))
def _(spark, root):
    return v.skus(spark, root).select(
        "sku", F.coalesce("color_family", F.lit("FloralPattern")).alias("family"))


@query("x13_add_cumulative", with_views(f"""
    select channel, pattern, launch_date, "units_2M" + "units_3M" as cumulative_units
    from (select * replace ({FILL_SQL}) from ({rel.WIDE_SQL}))""", "sku_daily"))
def _(spark, root):
    wide = op.zero_fill(rel.wide9(spark, root), FILLED)
    return op.add_cumulative(wide, "cumulative_units", ["units_2M", "units_3M"]).select(
        "channel", "pattern", "launch_date", "cumulative_units")


@query("x14_weighted_mean", with_views("""
    select channel, pattern, launch_date,
      round(("units_1W" * "avg_price_1W" + "units_2W" * "avg_price_2W" + "units_3W" * "avg_price_3W")
        / nullif("units_1W" + "units_2W" + "units_3W", 0), 6) as avgprice
    from (select * replace (""" + FILL_SQL + ") from (" + rel.WIDE_SQL + "))", "sku_daily"))
def _(spark, root):
    wide = op.zero_fill(rel.wide9(spark, root), FILLED)
    mean = fn.weighted_mean([(f"units_{w}", f"avg_price_{w}") for w in ("1W", "2W", "3W")])
    return wide.select("channel", "pattern", "launch_date", r6(mean).alias("avgprice"))


@query("x15_relative_price", with_views("""
    select slip, sku, retail_price, discount,
      round(case when discount = 0 then 1 else retail_price / nullif(discount, 0) end, 6) as ratio
    from clean""", "clean"))
def _(spark, root):
    return v.clean(spark, root).select(
        "slip", "sku", "retail_price", "discount",
        r6(fn.relative_price("retail_price", "discount")).alias("ratio"))


@query("x16_log_transform", with_views("""
    select slip, sku, round(case when amount + 0.001 > 0 then ln(amount + 0.001) end, 6) as amount,
      round(case when qty > 0 then ln(qty) end, 6) as qty,
      round(ln(discount + 1), 6) as discount
    from clean""", "clean"))
def _(spark, root):
    df = v.clean(spark, root).select("slip", "sku", "amount", "qty", "discount")
    df = op.log_transform(op.log_transform(df, ["amount"], 0.001), ["qty"])
    return rounded(op.log_transform(df, ["discount"], 1), "amount", "qty", "discount")


@query("x17_back_transform", """
    select l_orderkey, round(exp(l_discount), 6) as plain, round(exp(l_discount) - 1, 6) as offset_1
    from lineitem""")
def _(spark, root):
    return v.load_table(spark, "lineitem", root, ["l_orderkey", "l_discount"]).select(
        "l_orderkey", r6(fn.back_transform("l_discount")).alias("plain"),
        r6(fn.back_transform("l_discount", 1)).alias("offset_1"))


@query("x18_ceiling", with_views(
    "select sku, cast(ceil(avg(line_number)) as bigint) as lines from clean group by sku", "clean"))
def _(spark, root):
    return v.clean(spark, root).groupBy("sku").agg(F.ceil(F.avg("line_number")).alias("lines"))


@query("x19_line_margin_value", with_views("""
    select slip, sku, amount - std_cost as margin, retail_price * qty as value from clean""", "clean"))
def _(spark, root):
    return v.clean(spark, root).select(
        "slip", "sku", fn.line_margin("amount", "std_cost").alias("margin"),
        fn.line_value("retail_price", "qty").alias("value"))


@query("x20_date_shift", with_views("""
    select sku, launch_date - 90 as opens, launch_date - 1 as closes, launch_date + 21 as horizon
    from launches""", "launches"))
def _(spark, root):
    launches = op.launch_dates(v.clean(spark, root), v.skus(spark, root), "inner")
    return launches.select(
        "sku", F.date_sub("launch_date", 90).alias("opens"),
        F.date_sub("launch_date", 1).alias("closes"), F.date_add("launch_date", 21).alias("horizon"))


@query("x21_clamp", with_views(
    "select slip, sku, case when qty is null then null else greatest(least(qty, 40), 5) end as qty from clean",
    "clean"))
def _(spark, root):
    return v.clean(spark, root).select("slip", "sku", fn.clamp("qty", 5, 40).alias("qty"))


IMPUTED = ", ".join(
    f"round(case when launch_date <= date '{r.cutoff}' then _d_{c} else {c} end, 6) as {c}"
    for r in rel.RULES for c in (r.count_col, r.mean_col))


@query("x22_impute_early", with_views(
    f"select {', '.join(rel.GROUP)}, pattern, launch_date, {IMPUTED} from overlap left join donors using ({', '.join(rel.GROUP)})",
    "sku_daily", pattern_days=rel.DAILY_SQL, overlap=rel.overlap_metrics_sql(), donors=rel.DONOR_SQL))
def _(spark, root):
    overlap = op.materialize(rel.overlap_metrics(spark, root))
    cols = [c for r in rel.RULES for c in (r.count_col, r.mean_col)]
    out = op.impute_early(overlap, rel.GROUP, rel.RULES)
    return rounded(out.select(*rel.GROUP, "pattern", "launch_date", *cols), *cols)


# --- reshape ------------------------------------------------------------------------------


@query("r1_pivot_wide", with_views(rel.WIDE_SQL, "sku_daily"))
def _(spark, root):
    return rel.wide9(spark, root)


POS_VALUES = ("totalsales", "units", "margins", "avg_price", "count_styles", "count_stores")
TAGS10 = tuple(t for t, _ in fn.SCHEME_WEEK4)


@query("r2_pivot_wide_pos", with_views(
    rel.pivot_sql(f"({rel.MODEL_POS_SQL})", "district, pattern, merchant_class, cluster",
                  "group_tag", TAGS10, POS_VALUES), "store_buckets", "skus"))
def _(spark, root):
    rows = op.model_aggregate_pos(v.store_buckets(spark, root), rel.clusters(spark, root))
    return op.pivot_wide(rows, ["district", "pattern", "merchant_class", "cluster"],
                         "group_tag", TAGS10, POS_VALUES)


@query("r3_pivot_by_district", with_views(rel.DISTRICT_WIDE_SQL, "store_buckets"))
def _(spark, root):
    return rel.district_wide(rel.district_profile(spark, root))
