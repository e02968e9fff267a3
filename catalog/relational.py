"""Queries: scans, projections, filters, joins, aggregates, windows, top-k, unions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import views as v
from catalog.registry import query, rounded
from catalog.views import measures_sql, money_sql, ratio_sql, resum_sql, with_views
from launchlens import functions as fn
from launchlens import operators as op

WEB = op.WEB_SPEC
POS = op.POS_SPEC

# --- scans -----------------------------------------------------------------------------


@query("s1_load_table", "select * from part")
def _(spark, root):
    return v.load_table(spark, "part", root)


@query("s2_load_columns", "select l_orderkey, l_partkey, l_quantity from lineitem")
def _(spark, root):
    return v.load_table(spark, "lineitem", root, ["l_orderkey", "l_partkey", "l_quantity"])


# --- projections ------------------------------------------------------------------------


@query("p1_conform", """
    select try_cast(cast(l_partkey as varchar) as bigint) as sku,
      cast(l_shipdate as date) as sale_date,
      try_cast(case when l_returnflag = 'A' then 'none' else cast(l_quantity as varchar) end as double)
        as sale_quantity,
      cast(l_orderkey as varchar) as slip
    from lineitem""")
def _(spark, root):
    text = v.load_table(spark, "lineitem", root).select(
        F.col("l_partkey").cast("string").alias("sku"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("sale_date"),
        F.when(F.col("l_returnflag") == "A", "none").otherwise(F.col("l_quantity").cast("string"))
        .alias("sale_quantity"),
        F.col("l_orderkey").alias("slip"),
    )
    spec = T.StructType([
        T.StructField("sku", T.LongType()), T.StructField("sale_date", T.DateType()),
        T.StructField("sale_quantity", T.DoubleType()), T.StructField("slip", T.StringType()),
    ])
    return op.conform(text, spec)


@query("p2_to_date_col", """
    select o_orderkey, case when o_orderstatus <> 'P' then cast(o_orderdate as date) end as order_date
    from orders""")
def _(spark, root):
    text = F.when(F.col("o_orderstatus") == "P", "pending").otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd"))
    return v.load_table(spark, "orders", root).select(
        "o_orderkey", fn.to_date_col(text).alias("order_date"))


@query("p3_epoch_days_to_date", """
    select o_orderkey, date '1970-01-01' + cast(o_orderkey % 20000 as int) as day from orders""")
def _(spark, root):
    return v.load_table(spark, "orders", root, ["o_orderkey"]).withColumn(
        "day", fn.epoch_days_to_date(F.col("o_orderkey") % 20000))


@query("p4_date_to_epoch_days", """
    select o_orderkey, cast(cast(o_orderdate as date) - date '1970-01-01' as int) as days from orders""")
def _(spark, root):
    return v.load_table(spark, "orders", root).select(
        "o_orderkey", fn.date_to_epoch_days(F.col("o_orderdate").cast("date")).alias("days"))


@query("p5_projection", with_views("""
    select sku, order_date, order_number, order_line_number, amount, standard_cost, retail_price,
      confirmed_quantity, web_discount from raw_web""", "raw_web"))
def _(spark, root):
    return v.raw_web(spark, root).select(
        "sku", "order_date", "order_number", "order_line_number", "amount", "standard_cost",
        "retail_price", "confirmed_quantity", "web_discount")


PROFILE_SQL = f"""
    select pattern, count(distinct sku) as count_sku, count(distinct style) as count_styles,
      count(distinct merchant_class) as count_merchantclass, {money_sql('totalsales')} as totalsales,
      {money_sql('units')} as units, {money_sql('margins')} as total_margins,
      {ratio_sql('margins', 'units')} as avg_margins, {ratio_sql('price', 'units')} as avg_price
    from sku_daily where tag9 in ('1W', '2W', '3W') group by pattern"""


def early_profile(spark, root):
    return op.pattern_profile(op.first_buckets(v.sku_daily(spark, root), col="tag9"))


@query("p6_select_numeric", with_views(
    f"select * exclude (pattern, total_margins) from ({PROFILE_SQL})", "sku_daily"))
def _(spark, root):
    return op.select_numeric(early_profile(spark, root), ["total_margins"])


@query("p7_drop_columns", with_views(
    "select * exclude (discount, tax, std_cost) from clean", "clean"))
def _(spark, root):
    return v.clean(spark, root).drop("discount", "tax", "std_cost")


@query("p8_rename_columns", with_views(
    "select sku, pattern as color_description, style as style_description from skus", "skus"))
def _(spark, root):
    return v.skus(spark, root).select("sku", "pattern", "style").withColumnsRenamed(
        {"pattern": "color_description", "style": "style_description"})


@query("p9_tag_channel", with_views("select 'Web' as tag, * from raw_web", "raw_web"))
def _(spark, root):
    return op.tag_channel(v.raw_web(spark, root), "Web", "tag")


@query("p10_align_to", with_views("""
    select cast(null as bigint) as store, sku, cast(null as varchar) as district, amount,
      web_discount from raw_web""", "raw_web"))
def _(spark, root):
    schema = T.StructType([
        T.StructField("store", T.LongType()), T.StructField("sku", T.LongType()),
        T.StructField("district", T.StringType()), T.StructField("amount", T.DoubleType()),
        T.StructField("web_discount", T.DoubleType()),
    ])
    return op.align_to(v.raw_web(spark, root), schema)


@query("p11_attach_column", with_views(
    "select sku, sale_date, launch_date, age, tag9 from aged", "aged"))
def _(spark, root):
    lines = v.aged(spark, root).select("sku", "sale_date", "launch_date")
    return lines.withColumn("age", fn.age_days("sale_date", "launch_date")).withColumn(
        "tag9", fn.age_bucket("age", fn.SCHEME_WEEK3))


@query("p12_keep_ids", with_views("""
    select sku, pattern, merchant_class, pattern as pattern_id, merchant_class as merchant_class_id
    from skus""", "skus"))
def _(spark, root):
    return op.keep_ids(v.skus(spark, root).select("sku", "pattern", "merchant_class"),
                       ["pattern", "merchant_class"])


# --- filters ----------------------------------------------------------------------------


@query("f1_equality", with_views("select * from raw_web where order_entry_method = 1", "raw_web"))
def _(spark, root):
    return v.raw_web(spark, root).filter(F.col("order_entry_method") == 1)


@query("f2_exclude_values", with_views(
    "select * from skus where color_family not in ('Floral')", "skus"))
def _(spark, root):
    return op.exclude_values(v.skus(spark, root), "color_family", ["Floral"])


SEASONS = ("S95", "m96", "F97", "W98", "S98", "F95")


@query("f3_keep_values", with_views(
    f"select * from skus where season_code in {SEASONS}", "skus"))
def _(spark, root):
    return op.keep_values(v.skus(spark, root), "season_code", SEASONS)


@query("f4_launched_between", with_views("""
    select * from launches where launch_date >= date '1995-01-01' and launch_date <= date '1996-06-30'
    """, "launches"))
def _(spark, root):
    launches = op.launch_dates(v.clean(spark, root), v.skus(spark, root), "inner")
    return op.launched_between(launches, "1995-01-01", "1996-06-30")


@query("f5_positive_values", with_views("select * from sku_daily where price > 0", "sku_daily"))
def _(spark, root):
    return v.sku_daily(spark, root).filter(F.col("price") > 0)


@query("f6_require_non_negative", with_views(
    "select * from sku_daily where totalsales >= 0 and units >= 0 and margins >= 0", "sku_daily"))
def _(spark, root):
    return op.require_non_negative(v.sku_daily(spark, root), ["totalsales", "units", "margins"])


WIDE_IDS = "channel, pattern, merchant_class, season, solid_flag, launch_date"
AGG_SQL = f"""
    select channel, pattern, merchant_class, season, solid_flag, tag9 as group_tag,
      min(launch_date) as launch_date, {money_sql('totalsales')} as totalsales,
      {money_sql('units')} as units, {ratio_sql('margins', 'units')} as avg_margins,
      {ratio_sql('price', 'units')} as avg_price
    from sku_daily
    group by channel, pattern, merchant_class, season, solid_flag, tag9"""
TAGS9 = tuple(t for t, _ in fn.SCHEME_WEEK3)
VALUES9 = ("totalsales", "units", "avg_margins", "avg_price")


def pivot_sql(source: str, ids: str, key: str, keys, values) -> str:
    cells = ", ".join(
        f"max(case when {key} = '{k}' then {val} end) as \"{val}_{k}\"" for val in values for k in keys
    )
    return f"select {ids}, {cells} from {source} group by {ids}"


WIDE_SQL = pivot_sql(f"({AGG_SQL})", WIDE_IDS, "group_tag", TAGS9, VALUES9)


def aggregate9(spark, root):
    return op.model_aggregate(v.sku_daily(spark, root).withColumnRenamed("tag9", "group_tag"))


def wide9(spark, root):
    return op.pivot_wide(aggregate9(spark, root), WIDE_IDS.split(", "), "group_tag", TAGS9, VALUES9)


@query("f7_drop_burst_only", with_views(f"""
    select channel, pattern, "units_1W", "units_2M" from ({WIDE_SQL})
    where not ("units_2M" <= 20 and "units_1W" + "units_2W" > 20)""", "sku_daily"))
def _(spark, root):
    out = op.drop_burst_only(wide9(spark, root), "units_2M", ["units_1W", "units_2W"], 20)
    return out.select("channel", "pattern", "units_1W", "units_2M")


@query("f8_not_null", with_views("select * from clean where discount is not null", "clean"))
def _(spark, root):
    return v.clean(spark, root).filter(F.col("discount").isNotNull())


@query("f9_prefix_match", with_views(
    "select * from skus where season_code ilike 'M%'", "skus"))
def _(spark, root):
    return v.skus(spark, root).filter(F.col("season_code").ilike("M%"))


@query("f10_first_buckets", with_views(
    "select * from sku_daily where tag9 in ('1W', '2W', '3W')", "sku_daily"))
def _(spark, root):
    return op.first_buckets(v.sku_daily(spark, root), col="tag9")


@query("f11_having_sum", with_views(f"""
    select slip, {money_sql('amount')} as amount from sales_lines group by slip
    having sum(cast(amount as decimal(28,10))) < 0""", "sales_lines"))
def _(spark, root):
    sums = v.sales_lines(spark, root).groupBy("slip").agg(fn.exact_sum("amount").alias("amount"))
    return sums.filter(F.col("amount") < 0)


# --- joins ------------------------------------------------------------------------------


@query("j1_drop_negative_groups", with_views("select * from clean", "clean"))
def _(spark, root):
    return v.clean(spark, root)


@query("j2_keep_sold_skus", with_views(
    "select * from skus where sku in (select distinct sku from web)", "skus", "web"))
def _(spark, root):
    return op.keep_sold_skus(v.skus(spark, root), v.web(spark, root))


@query("j3_keep_sold_skus_both", with_views("""
    select * from skus where sku in (select sku from web union all select sku from pos)""",
    "skus", "web", "pos"))
def _(spark, root):
    return op.keep_sold_skus(v.skus(spark, root), v.web(spark, root), v.pos(spark, root))


@query("j4_join_first_sale", with_views("""
    select p.sku, p.sale_date, p.slip, p.net_sale_amount, f.first_sale from pos p
    join (select sku, min(sale_date) as first_sale from pos group by sku) f on f.sku = p.sku""", "pos"))
def _(spark, root):
    pos = v.pos(spark, root).select("sku", "sale_date", "slip", "net_sale_amount")
    return pos.join(op.first_sale(pos), "sku")


@query("j5_enrich_sku", with_views("""
    select d.sku, d.sale_date, d.totalsales, s.pattern, s.style, s.merchant_class
    from (select sku, sale_date, """ + money_sql("amount") + """ as totalsales from clean group by all) d
    join skus s on s.sku = d.sku""", "clean", "skus"))
def _(spark, root):
    days = v.clean(spark, root).groupBy("sku", "sale_date").agg(
        fn.exact_sum("amount").alias("totalsales"))
    return op.enrich_sku(days, v.skus(spark, root), ["pattern", "style", "merchant_class"])


TOP_SQL = f"""
    select pattern, {money_sql('totalsales')} as totalsales from sku_daily
    group by pattern order by totalsales desc, pattern limit 20"""


@query("j6_restrict_to", with_views(
    f"select * from sku_daily where pattern in (select pattern from ({TOP_SQL}))", "sku_daily"))
def _(spark, root):
    # Days are rolled up once: in one plan the list and the rows scan the lines four times each.
    base = op.materialize(v.sku_daily(spark, root))
    return op.restrict_to(base, op.top_patterns(base, 20))


@query("j7_enrich_left", with_views("""
    select p.*, s.state, s.district from pos p left join stores s
      on s.store = p.store and s.store_type = 'Full Line'""", "pos", "stores"))
def _(spark, root):
    full = v.stores(spark, root).filter(F.col("store_type") == "Full Line")
    return op.enrich(v.pos(spark, root), full, "store", ["state", "district"])


@query("j8_enrich_sku_store", with_views("select * from store_buckets", "store_buckets"))
def _(spark, root):
    return v.store_buckets(spark, root)


@query("j9_attach_features_left", with_views(f"""
    select d.channel, d.pattern, d.merchant_class, d.sale_date, d.sku, d.units, f.n_sku, f.class_units
    from sku_daily d left join (
      select channel, pattern, merchant_class, count(distinct sku) as n_sku,
        {money_sql('units')} as class_units
      from sku_daily where tag9 = '1W' group by all) f
    on f.channel = d.channel and f.pattern = d.pattern and f.merchant_class = d.merchant_class""",
    "sku_daily"))
def _(spark, root):
    base = v.sku_daily(spark, root)
    keys = ["channel", "pattern", "merchant_class"]
    feats = base.filter(F.col("tag9") == "1W").groupBy(*keys).agg(
        F.count_distinct("sku").alias("n_sku"), fn.exact_sum("units").alias("class_units"))
    return op.attach_features(base.select(*keys, "sale_date", "sku", "units"), feats, keys)


DISTRICTS = ("AFRICA", "AMERICA", "ASIA", "MIDDLE EAST")
DISTRICT_SQL = f"""
    select pattern, district, count(distinct merchant_class) as count_merchant_class,
      count(distinct sku) as count_sku, count(distinct style) as count_styles,
      count(distinct store) as count_stores, {money_sql('totalsales')} as totalsales,
      {money_sql('units')} as units, {money_sql('margins')} as margins,
      {ratio_sql('price', 'units')} as avg_price
    from store_buckets where district in {DISTRICTS} group by pattern, district"""
COUNTS_SQL = f"""
    select pattern, cast(sum(count_merchant_class) as bigint) as count_merchant_class,
      cast(sum(count_sku) as bigint) as count_sku, cast(sum(count_styles) as bigint) as count_styles
    from ({DISTRICT_SQL}) group by pattern"""
DISTRICT_VALUES = ("totalsales", "units", "margins", "avg_price", "count_stores")
SHORT = {"MIDDLE EAST": "MIDDLEEAST"}
SHORT_NAMES = [SHORT.get(d, d) for d in DISTRICTS]
SHORT_SQL = f"""
    select * replace (case when district = 'MIDDLE EAST' then 'MIDDLEEAST' else district end as district)
    from ({DISTRICT_SQL})"""
DISTRICT_WIDE_SQL = pivot_sql(f"({SHORT_SQL})", "pattern", "district", SHORT_NAMES, DISTRICT_VALUES)


def district_profile(spark, root):
    return op.pattern_district_profile(v.store_buckets(spark, root), DISTRICTS)


def district_wide(profile):
    rows = profile.withColumn("district", fn.recode("district", SHORT))
    return op.pivot_wide(rows, ["pattern"], "district", SHORT_NAMES, DISTRICT_VALUES)


@query("j10_attach_features_inner", with_views(f"""
    select w.*, c.count_merchant_class, c.count_sku, c.count_styles
    from ({DISTRICT_WIDE_SQL}) w join ({COUNTS_SQL}) c on c.pattern = w.pattern""", "store_buckets"))
def _(spark, root):
    profile = op.materialize(district_profile(spark, root))
    return op.attach_features(district_wide(profile), op.pattern_counts(profile), ["pattern"], "inner")


FIRST_LAUNCH_SQL = """
    select pattern, merchant_class, min(launch_date) as launch_date from sku_daily group by all"""
BAND_JOINS = {"3m": (-90, -60), "2m": (-60, -30), "1m": (-30, -1)}
OVERLAP_COUNTS_SQL = f"""
    select a.pattern, a.merchant_class, a.launch_date, {', '.join(
        f"count(distinct case when b.launch_date between a.launch_date + ({lo}) and a.launch_date + ({hi}) "
        f"then b.pattern end) as existing_{name}" for name, (lo, hi) in BAND_JOINS.items())}
    from first_launches a left join first_launches b
      on b.pattern <> a.pattern and b.merchant_class = a.merchant_class
      and b.launch_date between a.launch_date - 90 and a.launch_date - 1
    group by a.pattern, a.merchant_class, a.launch_date"""


@query("j11_launch_overlap_counts", with_views(
    OVERLAP_COUNTS_SQL, "sku_daily", first_launches=FIRST_LAUNCH_SQL))
def _(spark, root):
    return op.launch_overlap_counts(op.materialize(op.first_launch(v.sku_daily(spark, root))))


DAILY_SQL = f"""
    select channel, pattern, merchant_class, solid_flag, sale_date,
      min(min(launch_date)) over (partition by pattern, merchant_class, channel) as launch_date,
      {money_sql('totalsales')} as totalsales, {money_sql('units')} as units,
      {money_sql('margins')} as margins, {money_sql('price')} as price
    from sku_daily group by channel, pattern, merchant_class, solid_flag, sale_date"""


def overlap_metrics_sql(daily: str = "pattern_days") -> str:
    """One left join per window, as the operator is defined."""
    keys = "channel, merchant_class, solid_flag, pattern, launch_date"
    parts = []
    for name, days in op.WINDOWS.items():
        parts.append(f"""(
          select {', '.join(f'a.{k}' for k in keys.split(', '))},
            count(distinct b.pattern) as launched_{name},
            {money_sql('b.totalsales')} as existing_{name}_totalsales,
            {money_sql('b.units')} as existing_{name}_units,
            {ratio_sql('b.margins', 'b.units')} as existing_{name}_avgmargins,
            {ratio_sql('b.totalsales', 'b.units')} as existing_{name}_avg_price
          from (select distinct {keys} from {daily}) a left join {daily} b
            on b.pattern <> a.pattern and b.merchant_class = a.merchant_class and b.channel = a.channel
            and b.solid_flag = a.solid_flag
            and b.launch_date between a.launch_date - {days} and a.launch_date - 1
            and b.sale_date between a.launch_date and a.launch_date + 21
          group by all) m{name}""")
    return f"select * from {parts[0]} join {parts[1]} using ({keys}) join {parts[2]} using ({keys})"


def overlap_metrics(spark, root):
    days = op.materialize(op.pattern_daily(v.sku_daily(spark, root)))
    return op.launch_overlap_metrics(days)


@query("j12_launch_overlap_metrics", with_views(
    overlap_metrics_sql(), "sku_daily", pattern_days=DAILY_SQL))
def _(spark, root):
    return overlap_metrics(spark, root)


@query("j13_attach_color_family", with_views("""
    select distinct a.pattern, a.merchant_class, a.launch_date, b.color_family
    from (select pattern, merchant_class, min(launch_date) as launch_date from sku_daily group by all) a
    left join skus b on a.pattern = b.pattern and a.merchant_class = b.merchant_class""",
    "sku_daily", "skus"))
def _(spark, root):
    return op.attach_color_family(op.first_launch(v.sku_daily(spark, root)), v.skus(spark, root))


@query("j14_theta_other_patterns", with_views("""
    select a.pattern, a.merchant_class, a.launch_date, count(distinct b.pattern) as existing_prior
    from first_launches a left join first_launches b
      on b.pattern <> a.pattern and b.merchant_class = a.merchant_class
      and b.launch_date between a.launch_date - 3650 and a.launch_date - 1
    group by a.pattern, a.merchant_class, a.launch_date""", "sku_daily", first_launches=FIRST_LAUNCH_SQL))
def _(spark, root):
    launches = op.materialize(op.first_launch(v.sku_daily(spark, root)))
    return op.launch_overlap_counts(launches, {"prior": (-3650, -1)})


# --- aggregates ---------------------------------------------------------------------------


@query("a1_negative_groups", with_views("select slip from bad", "bad"))
def _(spark, root):
    return op.negative_groups(v.sales_lines(spark, root), "slip", v.MONEY)


@query("a2_first_sale", with_views(
    "select sku, min(sale_date) as first_sale from pos group by sku", "pos"))
def _(spark, root):
    return op.first_sale(v.pos(spark, root))


WEB_MEASURES = measures_sql("amount", "confirmed_quantity", "order_number", "standard_cost")
POS_MEASURES = measures_sql("net_sale_amount", "sale_quantity", "slip", "standard_cost")


def launch_sql(lines: str, date: str, join: str = "join") -> str:
    return f"""
      select f.sku, case when s.launch_date is null or s.launch_date > f.first_sale
          then f.first_sale else s.launch_date end as launch_date
      from (select sku, min({date}) as first_sale from {lines} group by sku) f
      {join} skus s on s.sku = f.sku"""


@query("a3_daily_rollup_web", with_views(f"""
    select w.sku, w.order_date as sale_date, l.launch_date, {WEB_MEASURES}
    from web w join ({launch_sql('web', 'order_date')}) l on l.sku = w.sku group by all""", "web", "skus"))
def _(spark, root):
    return op.with_launch(op.daily_rollup(v.web(spark, root), WEB), v.skus(spark, root), "inner")


WEB_FLAG = "case when web_discount is null or web_discount = 0 then 0 else 1 end"
POS_FLAG = "case when sale_discount + misc_discount > 0 then 1 else 0 end"


@query("a4_daily_rollup_web_flag", with_views(f"""
    select sku, order_date as sale_date, {WEB_FLAG} as discount_flag, {WEB_MEASURES}
    from web group by all""", "web"))
def _(spark, root):
    return op.daily_rollup(v.web(spark, root), WEB, discount_flag=fn.web_discount_flag("web_discount"))


@query("a5_daily_rollup_pos", with_views(
    f"select sku, store, sale_date, {POS_MEASURES} from pos group by all", "pos"))
def _(spark, root):
    return op.daily_rollup(v.pos(spark, root), POS, ["store"])


@query("a6_daily_rollup_pos_flag", with_views(f"""
    select sku, store, sale_date, {POS_FLAG} as discount_flag, {POS_MEASURES}
    from pos group by all""", "pos"))
def _(spark, root):
    flag = fn.pos_discount_flag("sale_discount", "misc_discount")
    return op.daily_rollup(v.pos(spark, root), POS, ["store"], flag)


POS_DAYS_SQL = f"select sku, store, sale_date, {POS_MEASURES} from pos group by all"
DISTRICT_DAYS_SQL = f"""
    select d.sku, s.district, d.sale_date, {resum_sql()} from pos_days d
    left join stores s on s.store = d.store where s.store_type = 'Full Line' group by all"""


@query("a7_rollup_to_district", with_views(DISTRICT_DAYS_SQL, "pos", "stores", pos_days=POS_DAYS_SQL))
def _(spark, root):
    days = op.daily_rollup(v.pos(spark, root), POS, ["store"])
    joined = op.enrich(days, v.stores(spark, root), "store", ["district", "store_type"])
    return op.rollup_to(
        joined.filter(F.col("store_type") == "Full Line"), ["sku", "district", "sale_date"])


COMBINED_SQL = f"""
    select channel, sku, sale_date, min(launch_date) as launch_date, {resum_sql()} from (
      select 'Web' as channel, sku, sale_date, launch_date, totalsales, trans, units, margins, price
      from (select sku, order_date as sale_date, {WEB_MEASURES} from web group by all)
        join ({launch_sql('web', 'order_date')}) using (sku)
      where sku > 0
      union all
      select 'Pos' as channel, sku, sale_date, launch_date, totalsales, trans, units, margins, price
      from pos_days left join ({launch_sql('pos', 'sale_date')}) using (sku))
    where price > 0 group by channel, sku, sale_date"""


@query("a8_combine_channels", with_views(COMBINED_SQL, "web", "pos", "skus", pos_days=POS_DAYS_SQL))
def _(spark, root):
    web, pos, skus = v.web(spark, root), v.pos(spark, root), v.skus(spark, root)
    web_days = op.with_launch(op.daily_rollup(web, WEB), skus, "inner")
    pos_days = op.with_launch(op.daily_rollup(pos, POS, ["store"]), skus, "inner")
    return op.combine_channels(web_days, pos_days.drop("store"))


def bucketed_sql(days: str, lines: str, date: str, keys: str) -> str:
    tag = v.bucket_tag_sql("(d.sale_date - l.launch_date)", fn.SCHEME_WEEK4)
    return f"""
      select {keys}, launch_date, discount_flag, group_tag, {resum_sql()} from (
        select d.*, l.launch_date, {tag} as group_tag
        from ({days}) d join ({launch_sql(lines, date, 'left join')}) l on l.sku = d.sku)
      group by all"""


WEB_FLAG_DAYS_SQL = f"""
    select sku, order_date as sale_date, {WEB_FLAG} as discount_flag, {WEB_MEASURES} from web group by all"""
POS_FLAG_DAYS_SQL = f"""
    select sku, store, sale_date, {POS_FLAG} as discount_flag, {POS_MEASURES} from pos group by all"""
WEB_BUCKETS_SQL = bucketed_sql(WEB_FLAG_DAYS_SQL, "web", "order_date", "sku")
POS_BUCKETS_SQL = bucketed_sql(POS_FLAG_DAYS_SQL, "pos", "sale_date", "sku, store")


def _tagged(days, skus):
    return op.with_launch(days, skus).withColumn(
        "group_tag", fn.age_bucket(fn.age_days("sale_date", "launch_date"), fn.SCHEME_WEEK4))


@query("a9_bucket_rollup_web", with_views(WEB_BUCKETS_SQL, "web", "skus"))
def _(spark, root):
    days = op.daily_rollup(
        v.web(spark, root), WEB, discount_flag=fn.web_discount_flag("web_discount"))
    return op.bucket_rollup(_tagged(days, v.skus(spark, root)))


@query("a10_bucket_rollup_pos", with_views(POS_BUCKETS_SQL, "pos", "skus"))
def _(spark, root):
    pos = v.pos(spark, root)
    days = op.daily_rollup(
        pos, POS, ["store"], fn.pos_discount_flag("sale_discount", "misc_discount"))
    return op.bucket_rollup(_tagged(days, v.skus(spark, root)),
                            ["sku", "store", "launch_date", "discount_flag"])


@query("a11_pattern_totals", with_views(
    f"select pattern, {money_sql('totalsales')} as totalsales from sku_daily group by pattern",
    "sku_daily"))
def _(spark, root):
    return v.sku_daily(spark, root).groupBy("pattern").agg(
        fn.exact_sum("totalsales").alias("totalsales"))


@query("a12_pattern_profile", with_views(PROFILE_SQL, "sku_daily"))
def _(spark, root):
    return early_profile(spark, root)


@query("a13_pattern_district_profile", with_views(DISTRICT_SQL, "store_buckets"))
def _(spark, root):
    return district_profile(spark, root)


@query("a14_pattern_counts", with_views(COUNTS_SQL, "store_buckets"))
def _(spark, root):
    return op.pattern_counts(district_profile(spark, root))


CLUSTERS_SQL = """
    select distinct pattern, cast(length(pattern) % 3 + 1 as int) as cluster from skus
    where length(pattern) % 5 <> 0"""


def clusters(spark, root):
    """Stand-in labels that SQL can state, for queries that take clusters as an input."""
    return v.skus(spark, root).filter(F.length("pattern") % 5 != 0).select(
        "pattern", (F.length("pattern") % 3 + 1).cast("int").alias("cluster")).distinct()


MODEL_POS_SQL = f"""
    select b.district, b.pattern, b.merchant_class, c.cluster, b.group_tag,
      {money_sql('totalsales')} as totalsales, {money_sql('units')} as units,
      {money_sql('margins')} as margins, {ratio_sql('price', 'units')} as avg_price,
      count(distinct style) as count_styles, count(distinct store) as count_stores
    from store_buckets b left join ({CLUSTERS_SQL}) c on c.pattern = b.pattern group by all"""


@query("a15_model_aggregate_pos", with_views(MODEL_POS_SQL, "store_buckets", "skus"))
def _(spark, root):
    return op.model_aggregate_pos(v.store_buckets(spark, root), clusters(spark, root))


@query("a16_model_aggregate", with_views(AGG_SQL, "sku_daily"))
def _(spark, root):
    return aggregate9(spark, root)


@query("a17_first_launch", with_views(FIRST_LAUNCH_SQL, "sku_daily"))
def _(spark, root):
    return op.first_launch(v.sku_daily(spark, root))


@query("a18_pattern_daily", with_views(DAILY_SQL, "sku_daily"))
def _(spark, root):
    return op.pattern_daily(v.sku_daily(spark, root))


@query("a19_count_distinct", with_views("""
    select pattern, count(distinct slip) as slips, count(distinct sku) as skus,
      count(distinct store) as stores from aged group by pattern""", "aged"))
def _(spark, root):
    # Sums are not wanted here, so the rows are made distinct once for all three counts.
    rows = v.aged(spark, root).select("pattern", "slip", "sku", "store").distinct()
    return rows.groupBy("pattern").agg(
        F.count_distinct("slip").alias("slips"), F.count_distinct("sku").alias("skus"),
        F.count_distinct("store").alias("stores"))


@query("a20_ratio_of_sums", with_views(f"""
    select sku, channel, {ratio_sql('amount', 'qty')} as avg_price,
      {ratio_sql('amount - std_cost', 'qty')} as avg_margin from clean group by all""", "clean"))
def _(spark, root):
    return v.clean(spark, root).groupBy("sku", "channel").agg(
        fn.ratio_of_sums("amount", "qty").alias("avg_price"),
        fn.ratio_of_sums(fn.line_margin("amount", "std_cost"), "qty").alias("avg_margin"))


@query("a21_distinct_rows", with_views(
    "select distinct channel, pattern, merchant_class, launch_date, solid_flag from aged", "aged"))
def _(spark, root):
    return v.aged(spark, root).select(
        "channel", "pattern", "merchant_class", "launch_date", "solid_flag").distinct()


RULES = (
    op.ImputeRule("1995-06-01", "launched_3m", "existing_3m_avg_price"),
    op.ImputeRule("1995-04-01", "launched_2m", "existing_2m_avg_price"),
    op.ImputeRule("1995-03-01", "launched_1m", "existing_1m_avg_price"),
)
GROUP = ("channel", "merchant_class", "solid_flag")
DONORS = ", ".join(
    f"ceil(avg(case when launch_date > date '{r.cutoff}' then {r.count_col} end))::double as _d_{r.count_col}, "
    f"avg(case when launch_date > date '{r.cutoff}' then {r.mean_col} end) as _d_{r.mean_col}"
    for r in RULES)
DONOR_SQL = f"select {', '.join(GROUP)}, {DONORS} from overlap group by all"
DONOR_COLS = [f"_d_{c}" for r in RULES for c in (r.count_col, r.mean_col)]


def round_sql(cols, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) as {c}" for c in cols)


@query("a22_donor_means", with_views(
    f"select * replace ({round_sql(DONOR_COLS)}) from ({DONOR_SQL})",
    "sku_daily", pattern_days=DAILY_SQL, overlap=overlap_metrics_sql()))
def _(spark, root):
    overlap = overlap_metrics(spark, root)
    return rounded(op.donor_means(overlap, GROUP, RULES), *DONOR_COLS)


@query("a23_value_counts", with_views(
    "select store_type, count(*) as n from stores group by store_type", "stores"))
def _(spark, root):
    return op.value_counts(v.stores(spark, root), "store_type")


@query("a24_null_profile", with_views(
    " union all ".join(
        f"select '{c}' as \"column\", count(*) filter ({c} is null) as n_null from clean"
        for c in ("slip", "sku", "store", "line_number", "sale_date", "channel", "entry_method", "qty",
                  "amount", "std_cost", "retail_price", "discount", "tax")), "clean"))
def _(spark, root):
    return op.null_profile(v.clean(spark, root))


@query("a25_cleaning_audit", with_views("""
    select count(distinct slip) as n_before,
      count(distinct slip) filter (slip in (select slip from bad)) as n_removed,
      count(distinct slip) filter (slip not in (select slip from bad)) as n_after
    from sales_lines""", "sales_lines", "bad"))
def _(spark, root):
    return op.cleaning_audit(v.sales_lines(spark, root), "slip", v.MONEY)


QUANTILE_COLS = ("amount", "qty", "discount", "retail_price")


@query("a26_quantiles", with_views(
    " union all ".join(
        f"select '{c}' as \"column\", {p}::double as prob, round(quantile_cont({c}, {p}), 6) as value from clean"
        for c in QUANTILE_COLS for p in (0.01, 0.5, 0.99)), "clean"))
def _(spark, root):
    lines = op.materialize(v.clean(spark, root).select(*QUANTILE_COLS))
    return rounded(op.quantile_table(lines, QUANTILE_COLS, (0.01, 0.5, 0.99)), "value")


def skewness_sql(col: str, source: str) -> str:
    return f"""
      select '{col}' as "column",
        round((sum(power({col} - m, 3)) / count({col})) / power(sum(power({col} - m, 2)) / count({col}), 1.5), 6)
          as skewness
      from (select {col}, avg({col}) over () as m from {source} where {col} is not null)"""


@query("a27_skewness_profile", with_views(
    " union all ".join(skewness_sql(c, "sku_daily") for c in ("totalsales", "units", "margins")),
    "sku_daily"))
def _(spark, root):
    return rounded(op.skewness_profile(v.sku_daily(spark, root), ["totalsales", "units", "margins"]),
                   "skewness")


def histogram_sql(expr: str, source: str, bins: int) -> str:
    return f"""
      select cast(least(floor({bins} * (x - lo) / (hi - lo)), {bins - 1}) as int) as bin, count(*) as n
      from (select x, min(x) over () as lo, max(x) over () as hi from (select {expr} as x from {source})
        where x is not null) group by 1"""


@query("a28_histogram", with_views(histogram_sql("totalsales", "sku_daily", 20), "sku_daily"))
def _(spark, root):
    return op.histogram(v.sku_daily(spark, root), "totalsales", 20)


@query("a28_histogram_log", with_views(histogram_sql(
    "case when totalsales > 0 then ln(totalsales) end", "sku_daily", 20), "sku_daily"))
def _(spark, root):
    return op.histogram(v.sku_daily(spark, root), "totalsales", 20, log=True)


# --- windows, top-k, unions ------------------------------------------------------------------


@query("w1_min_launch_window", with_views(f"""
    select distinct channel, pattern, merchant_class, launch_date from ({DAILY_SQL})""", "sku_daily"))
def _(spark, root):
    return op.pattern_daily(v.sku_daily(spark, root)).select(
        "channel", "pattern", "merchant_class", "launch_date").distinct()


@query("t1_top_patterns", with_views(f"select * from ({TOP_SQL})", "sku_daily"))
def _(spark, root):
    return op.top_patterns(v.sku_daily(spark, root), 20)


@query("t2_sort_descending", with_views(f"""
    select pattern, {money_sql('totalsales')} as totalsales from sku_daily group by pattern
    order by totalsales desc, pattern""", "sku_daily"))
def _(spark, root):
    return v.sku_daily(spark, root).groupBy("pattern").agg(
        fn.exact_sum("totalsales").alias("totalsales")).orderBy(F.desc("totalsales"), "pattern")


@query("u1_union_bad_keys", with_views("""
    select slip from sales_lines group by slip having sum(cast(amount as decimal(28,10))) < 0
    union
    select slip from sales_lines group by slip having sum(cast(qty as decimal(28,10))) < 0""", "sales_lines"))
def _(spark, root):
    lines = v.sales_lines(spark, root)
    by_amount = op.negative_groups(lines, "slip", ["amount"])
    return by_amount.union(op.negative_groups(lines, "slip", ["qty"])).distinct()


U_COLS = "sku, discount_flag, group_tag, totalsales, trans, units, margins, price"
WEB_SIDE = f"select 'WEB' as channel, null::bigint as store, {U_COLS} from ({WEB_BUCKETS_SQL})"
POS_SIDE = f"select 'POS' as channel, store, {U_COLS} from ({POS_BUCKETS_SQL})"


def channel_sides(spark, root):
    web, pos, skus = v.web(spark, root), v.pos(spark, root), v.skus(spark, root)
    web_days = op.daily_rollup(web, WEB, discount_flag=fn.web_discount_flag("web_discount"))
    web_side = op.bucket_rollup(_tagged(web_days, skus))
    pos_days = op.daily_rollup(
        pos, POS, ["store"], fn.pos_discount_flag("sale_discount", "misc_discount"))
    pos_side = op.bucket_rollup(_tagged(pos_days, skus),
                                ["sku", "store", "launch_date", "discount_flag"])
    return (op.tag_channel(web_side, "WEB").drop("launch_date"),
            op.tag_channel(pos_side, "POS").drop("launch_date"))


@query("u2_append_channels_distinct", with_views(
    f"{WEB_SIDE} union {POS_SIDE}", "web", "pos", "skus"))
def _(spark, root):
    return op.append_channels(*channel_sides(spark, root), distinct=True)


@query("u3_append_channels_all", with_views(
    f"{WEB_SIDE} union all {POS_SIDE}", "web", "pos", "skus"))
def _(spark, root):
    return op.append_channels(*channel_sides(spark, root), distinct=False)


@query("u4_union_sold_keys", with_views("""
    select sku, count(*) as sides from (select distinct sku from web union all select distinct sku from pos)
    group by sku""", "web", "pos"))
def _(spark, root):
    keys = v.web(spark, root).select("sku").distinct().union(v.pos(spark, root).select("sku").distinct())
    return keys.groupBy("sku").agg(F.count("*").alias("sides"))
