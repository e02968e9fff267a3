"""Queries: the composite workflows, step by step and end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import relational as rel
from catalog import scalar
from catalog import views as v
from catalog.registry import query, rounded
from catalog.views import money_sql, ratio_sql, resum_sql, with_views
from launchlens import functions as fn
from launchlens import operators as op
from launchlens.plans import common, store_channel, two_channel
from launchlens.plans.settings import StoreSettings, TwoChannelSettings

CODES = tuple(f"{s}{y}" for s in ("F", "m", "S", "W") for y in (95, 96, 97, 98))
CLASSES = ("ECONOMY", "LARGE", "MEDIUM", "SMALL", "STANDARD")
TWO = TwoChannelSettings(
    entry_method=1, excluded_stores=(7,), excluded_classes=("PROMO",), excluded_styles=("Brand#13",),
    seasons=CODES, launched_from="1994-09-01", launched_to="1997-06-30", n_patterns=20,
    classes=CLASSES, impute=rel.RULES, burst_limit=30,
    product_cols=("style", "pattern", "release_season", "merchant_class", "color_family"),
)
DISTRICTS = ("AFRICA", "AMERICA", "ASIA", "MIDDLE EAST")
STORE = StoreSettings(
    excluded_stores=(7,), districts=DISTRICTS, excluded_districts=("EUROPE",), seasons=CODES,
    launched_from="1994-09-01", cluster_launched_to="1997-06-30", classes=CLASSES,
    cluster_excluded=("red widget",), model_excluded=("red widget", "blue bolt"),
    product_cols=("style", "pattern", "release_season", "department", "color_family"),
    store_cols=("district",),
)


def listed(values) -> str:
    return "(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in values) + ")"


# --- C1: clean ---------------------------------------------------------------------------


@query("c1_clean_web", with_views("""
    select * exclude (order_entry_method) from raw_web where order_entry_method = 1
      and order_number not in (
        select order_number from raw_web where order_entry_method = 1 group by order_number
        having sum(cast(amount as decimal(28,10))) < 0 or sum(cast(confirmed_quantity as decimal(28,10))) < 0)
    """, "raw_web"))
def _(spark, root):
    return common.clean_web(v.raw_web(spark, root), TWO.entry_method)


@query("c1_clean_pos", with_views("select * from pos", "pos"))
def _(spark, root):
    return common.clean_pos(v.raw_pos(spark, root))


# --- two channels -------------------------------------------------------------------------

SKU_DAILY_SQL = f"""
    select c.*, m.style, m.pattern, m.release_season, m.merchant_class, m.color_family from (
      select channel, sku, sale_date, min(launch_date) as launch_date, {resum_sql()} from (
        select 'Web' as channel, sku, sale_date, launch_date, totalsales, trans, units, margins, price
        from (select sku, order_date as sale_date, {rel.WEB_MEASURES} from web group by all)
          join ({rel.launch_sql('web', 'order_date')}) using (sku)
        where sku > 0
        union all
        select 'Pos' as channel, d.sku, sale_date, l.launch_date, totalsales, trans, units, margins, price
        from (
          select p.sku, s.district, p.sale_date, {resum_sql()}
          from (select sku, store, sale_date, {rel.POS_MEASURES} from pos where store <> 7 group by all) p
          left join stores s on s.store = p.store
          where p.store <> 7 and s.store_type in ('Full Line') group by all) d
        left join ({rel.launch_sql('pos', 'sale_date')}) l on l.sku = d.sku)
      where price > 0 group by channel, sku, sale_date) c
    join master m on m.sku = c.sku where m.merchant_class <> 'PROMO'"""
CHAIN = ("web", "pos", "skus", "stores", "master")


def two_sku_daily(spark, root):
    return two_channel.build_sku_daily(
        v.web(spark, root), v.pos(spark, root), v.master(spark, root), v.stores(spark, root), TWO)


@query("c2_build_sku_daily", with_views(SKU_DAILY_SQL, *CHAIN))
def _(spark, root):
    return two_sku_daily(spark, root)


BASE_SQL = f"""
    select *, {v.bucket_tag_sql('(sale_date - launch_date)', fn.SCHEME_WEEK3)} as group_tag,
      case when color_family = 'Solid' then 'Solid' else 'Non-Solid' end as solid_flag
    from daily2
    where release_season in {listed(CODES)} and launch_date >= date '1994-09-01' and style <> 'Brand#13'"""
TOP_SQL = f"""
    select pattern, {money_sql('totalsales')} as totalsales from base2 group by pattern
    order by totalsales desc, pattern limit 20"""
TWO_VIEWS = {"daily2": SKU_DAILY_SQL, "base2": BASE_SQL, "top2": TOP_SQL}


def two_base(spark, root):
    return two_channel.focus(two_sku_daily(spark, root), TWO)


@query("c2_focus", with_views("select * from base2", *CHAIN, **TWO_VIEWS))
def _(spark, root):
    return two_base(spark, root)


EARLY_SQL = f"""
    select pattern, count(distinct sku) as count_sku, count(distinct style) as count_styles,
      count(distinct merchant_class) as count_merchantclass, {money_sql('totalsales')} as totalsales,
      {money_sql('units')} as units, {money_sql('margins')} as total_margins,
      {ratio_sql('margins', 'units')} as avg_margins, {ratio_sql('price', 'units')} as avg_price
    from base2 where group_tag in ('1W', '2W', '3W') and pattern in (select pattern from top2) group by pattern"""


@query("c5_early_profile", with_views(EARLY_SQL, *CHAIN, **TWO_VIEWS))
def _(spark, root):
    base = op.materialize(two_base(spark, root))
    return two_channel.early_profile(base, op.top_patterns(base, TWO.n_patterns))


@query("c5_cluster_patterns")
def _(spark, root):
    base = op.materialize(two_base(spark, root))
    return two_channel.cluster_patterns(base, op.top_patterns(base, TWO.n_patterns), TWO)


@query("c5_elbow")
def _(spark, root):
    base = op.materialize(two_base(spark, root))
    return two_channel.pattern_elbow(base, op.top_patterns(base, TWO.n_patterns), TWO)


DAYS2_SQL = f"""
    select channel, pattern, merchant_class, solid_flag, sale_date,
      min(min(launch_date)) over (partition by pattern, merchant_class, channel) as launch_date,
      {money_sql('totalsales')} as totalsales, {money_sql('units')} as units,
      {money_sql('margins')} as margins, {money_sql('price')} as price
    from base2 where pattern in (select pattern from top2)
    group by channel, pattern, merchant_class, solid_flag, sale_date"""
OVERLAP_VIEWS = {**TWO_VIEWS, "days2": DAYS2_SQL, "overlap2": rel.overlap_metrics_sql("days2")}


@query("c7_cannibalisation_metrics", with_views("select * from overlap2", *CHAIN, **OVERLAP_VIEWS))
def _(spark, root):
    base = op.materialize(two_base(spark, root))
    return two_channel.cannibalisation_metrics(base, op.top_patterns(base, TWO.n_patterns))


SUMMER_SQL = (
    "case when release_season ilike 'M%' then 'SUMMER' when release_season ilike 'S%' then 'Spring' "
    "when release_season ilike 'W%' then 'Winter' when release_season ilike 'F%' then 'Fall' end"
)
IDS = "channel, pattern, merchant_class, season, solid_flag, launch_date"
AGG2_SQL = f"""
    select channel, pattern, merchant_class, season, solid_flag, group_tag, min(launch_date) as launch_date,
      {money_sql('totalsales')} as totalsales, {money_sql('units')} as units,
      {ratio_sql('margins', 'units')} as avg_margins, {ratio_sql('price', 'units')} as avg_price
    from (select *, {SUMMER_SQL} as season from base2 where pattern in (select pattern from top2))
    group by channel, pattern, merchant_class, season, solid_flag, group_tag"""
WIDE2_SQL = (
    f"select * replace ({scalar.FILL_SQL}) from "
    f"({rel.pivot_sql(f'({AGG2_SQL})', IDS, 'group_tag', rel.TAGS9, rel.VALUES9)})"
)


@query("c9_wide_sales", with_views(WIDE2_SQL, *CHAIN, **TWO_VIEWS))
def _(spark, root):
    base = op.materialize(two_base(spark, root))
    return two_channel.wide_sales(base, op.top_patterns(base, TWO.n_patterns))


EARLY_UNITS = '"units_1W" + "units_2W" + "units_3W"'
FILL_OVERLAP = ", ".join(
    f"coalesce(o.{c}, 0) as {c}"
    for n in ("1m", "2m", "3m") for c in (f"launched_{n}", f"existing_{n}_avg_price"))
ROWS2_SQL = f"""
    select w.*, "units_2M" + "units_3M" as cumulative_units, c.cluster, {FILL_OVERLAP},
      ("units_1W" * "avg_price_1W" + "units_2W" * "avg_price_2W" + "units_3W" * "avg_price_3W")
        / nullif({EARLY_UNITS}, 0) as avgprice
    from wide2 w
    left join overlap2 o on o.channel = w.channel and o.merchant_class = w.merchant_class
      and o.pattern = w.pattern and o.launch_date = w.launch_date and o.solid_flag = w.solid_flag
    left join ({rel.CLUSTERS_SQL}) c on c.pattern = w.pattern
    where "totalsales_1W" + "totalsales_2W" + "totalsales_3W" > 0 and "units_2M" + "units_3M" > 0"""
DONOR2_SQL = f"select {', '.join(rel.GROUP)}, {rel.DONORS} from rows2 group by all"
IMPUTED = ", ".join(
    f"case when launch_date <= date '{r.cutoff}' then _d_{c} else {c} end as {c}"
    for r in rel.RULES for c in (r.count_col, r.mean_col))
NUMERIC2 = [c if c[-1] != "W" else f'"{c}"' for c in two_channel.NUMERIC]
TABLE2_SQL = f"""
    select channel, pattern, merchant_class, season, solid_flag, launch_date,
      monthname(launch_date) as month, cluster, cumulative_units,
      {', '.join(f'round({c}::double, 6) as {c}' for c in NUMERIC2)}
    from (select *, case when existing_3m_avg_price = 0 then 1
          else avgprice / nullif(existing_3m_avg_price, 0) end as relativeprice
        from (select r.* replace ({IMPUTED}) from rows2 r left join donors2 using ({', '.join(rel.GROUP)})))
    where merchant_class in {listed(CLASSES)} and launch_date <= date '1997-06-30'
      and not (cumulative_units <= 30 and {EARLY_UNITS} > 30)"""
TABLE2_VIEWS = {**OVERLAP_VIEWS, "wide2": WIDE2_SQL, "rows2": ROWS2_SQL, "donors2": DONOR2_SQL}


def two_table(spark, root, clusters=None):
    base = op.materialize(two_base(spark, root))
    top = op.top_patterns(base, TWO.n_patterns)
    overlap = two_channel.cannibalisation_metrics(base, top)
    labels = rel.clusters(spark, root) if clusters is None else clusters
    return two_channel.model_table(base, top, overlap, labels, TWO)


@query("c9_model_table", with_views(TABLE2_SQL, *CHAIN, **TABLE2_VIEWS))
def _(spark, root):
    return rounded(two_table(spark, root), *two_channel.NUMERIC)


@query("c9_matrix")
def _(spark, root):
    m = two_channel.matrix(two_table(spark, root), TWO)
    return m.df.select(*m.ids, m.y, *m.xs)


LOGGED2 = {f"{m}_{w}" for m in ("totalsales", "units") for w in two_channel.WEEKS}
HOLES2 = ", ".join(
    f"case when {sql} is null or {sql} + {TWO.log_offset if c in LOGGED2 else 0} <= 0 then '{c}' end"
    if c in LOGGED2 or c == "cumulative_units" else f"case when {sql} is null then '{c}' end"
    for c, sql in [("cumulative_units", "cumulative_units"), *zip(two_channel.NUMERIC, NUMERIC2)])


@query("c9_left_out", with_views(
    f"select * from (select {', '.join(f'{c} as {c}_id' for c in two_channel.IDS)}, concat_ws(',', {HOLES2}) as missing"
    f" from ({TABLE2_SQL})) where missing <> ''", *CHAIN, **TABLE2_VIEWS))
def _(spark, root):
    return two_channel.matrix(two_table(spark, root), TWO).left_out



@query("c11_train_all")
def _(spark, root):
    results = two_channel.run(
        v.web(spark, root), v.pos(spark, root), v.master(spark, root), v.stores(spark, root), TWO)
    return results["metrics"]


# --- stores -----------------------------------------------------------------------------------

PRODUCT = "m.style, m.pattern, m.release_season, m.department, m.color_family"
WEB3_SQL = f"""
    select b.*, {PRODUCT} from ({rel.WEB_BUCKETS_SQL}) b left join master m on m.sku = b.sku
    where m.department <> 'Marketing'"""
POS3_SQL = f"""
    select b.*, {PRODUCT}, s.district from ({rel.POS_BUCKETS_SQL}) b
    left join master m on m.sku = b.sku left join stores s on s.store = b.store
    where s.store_type in ('Full Line')"""


def store_buckets(spark, root):
    return store_channel.build_bucketed(
        v.web(spark, root), v.pos(spark, root), v.master(spark, root), v.stores(spark, root), STORE)


@query("c3_build_bucketed_web", with_views(WEB3_SQL, *CHAIN))
def _(spark, root):
    return store_buckets(spark, root)[0]


@query("c3_build_bucketed_pos", with_views(POS3_SQL, *CHAIN))
def _(spark, root):
    return store_buckets(spark, root)[1]


LIST_SQL = f"select pattern from (select pattern, {money_sql('price')} as p from pos3 group by pattern order by p desc, pattern limit 30)"
STUDIED = f"release_season in {listed(CODES)} and launch_date >= date '1994-09-01'"
SIDE = ("launch_date, discount_flag, group_tag, totalsales, trans, units, margins, price, style, pattern, "
        "release_season, department")
SEASON = v.SEASON_SQL.format(c="a.release_season")
BASE3_SQL = f"""
    select a.*, m.merchant_class, {SEASON} as season from (
      select 'WEB' as channel, sku, null::bigint as store, null::varchar as district, {SIDE}
      from web3 where {STUDIED}
      union
      select 'POS' as channel, sku, store, district, {SIDE} from pos3 where {STUDIED} and store <> 7) a
    left join master m on m.sku = a.sku join list3 l on l.pattern = a.pattern"""
BASE3_VIEWS = {"web3": WEB3_SQL, "pos3": POS3_SQL, "list3": LIST_SQL, "base3": BASE3_SQL}


def store_base(spark, root):
    web, pos = store_buckets(spark, root)
    pos = op.materialize(pos)
    totals = pos.groupBy("pattern").agg(fn.exact_sum("price").alias("p"))
    top = totals.orderBy(F.desc("p"), "pattern").limit(30).select("pattern")
    return store_channel.build_pattern_base(web, pos, v.master(spark, root), top, STORE)


@query("c4_build_pattern_base", with_views("select * from base3", *CHAIN, **BASE3_VIEWS))
def _(spark, root):
    return store_base(spark, root)


STORES3_SQL = f"""
    select * from base3 where district <> 'EUROPE' and merchant_class in {listed(CLASSES)} and channel = 'POS'"""
PROFILE3_SQL = f"""
    select pattern, district, count(distinct merchant_class) as count_merchant_class,
      count(distinct sku) as count_sku, count(distinct style) as count_styles,
      count(distinct store) as count_stores, {money_sql('totalsales')} as totalsales,
      {money_sql('units')} as units, {money_sql('margins')} as margins,
      {ratio_sql('price', 'units')} as avg_price
    from stores3 where group_tag in ('1W', '2W', '3W') and launch_date <= date '1997-06-30'
      and district in {listed(DISTRICTS)} group by pattern, district"""
NAMES3 = [d.replace(" ", "") for d in DISTRICTS]
FILL3 = ", ".join(
    f'coalesce("{val}_{d}", 0) as "{val}_{d}"' for val in store_channel.DISTRICT_VALUES for d in NAMES3)
COUNTED3 = ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in store_channel.COUNTS)
WIDE3_SQL = f"""
    select * from (select * replace ({FILL3}) from ({rel.pivot_sql(
        "(select * replace (replace(district, ' ', '') as district) from profile3)", 'pattern', 'district',
        NAMES3, store_channel.DISTRICT_VALUES)}))
    join (select pattern, {COUNTED3} from profile3 group by pattern) using (pattern)
    where pattern <> 'red widget'"""
STORES3_VIEWS = {**BASE3_VIEWS, "stores3": STORES3_SQL, "profile3": PROFILE3_SQL}


def stores_base(spark, root):
    base = op.materialize(store_base(spark, root))
    return base, store_channel.model_stores(base, STORE)


@query("c6_district_profile", with_views(WIDE3_SQL, *CHAIN, **STORES3_VIEWS))
def _(spark, root):
    return store_channel.district_profile(stores_base(spark, root)[1], v.stores(spark, root), STORE)


@query("c6_cluster_patterns_by_district")
def _(spark, root):
    return store_channel.cluster_patterns_by_district(
        stores_base(spark, root)[1], v.stores(spark, root), STORE)


@query("c6_elbow")
def _(spark, root):
    return store_channel.district_elbow(stores_base(spark, root)[1], v.stores(spark, root), STORE)


LAUNCHES3_SQL = f"""
    select pattern, merchant_class, min(launch_date) as launch_date from base3
    where district <> 'EUROPE' and merchant_class in {listed(CLASSES)} group by all"""
OVERLAP3_SQL = rel.OVERLAP_COUNTS_SQL.replace("first_launches", "launches3")
OVERLAP3_VIEWS = {**STORES3_VIEWS, "launches3": LAUNCHES3_SQL, "overlap3": OVERLAP3_SQL}


@query("c8_cannibalisation_counts", with_views("select * from overlap3", *CHAIN, **OVERLAP3_VIEWS))
def _(spark, root):
    base, _ = stores_base(spark, root)
    return store_channel.cannibalisation_counts(store_channel.pattern_launches(base, STORE))


AGG3_SQL = f"""
    select b.district, b.merchant_class, b.pattern, c.cluster, b.group_tag,
      {money_sql('totalsales')} as totalsales, {money_sql('units')} as units,
      {money_sql('margins')} as margins, {ratio_sql('price', 'units')} as avg_price,
      count(distinct style) as count_styles, count(distinct store) as count_stores
    from stores3 b left join ({rel.CLUSTERS_SQL}) c on c.pattern = b.pattern group by all"""
TAGS10 = store_channel.TAGS
FILL10 = ", ".join(f'coalesce("{c}", 0) as "{c}"' for c in store_channel.FILLED)
WIDE10_SQL = (
    f"select * replace ({FILL10}) from ({rel.pivot_sql(f'({AGG3_SQL})', 'district, merchant_class, pattern, cluster', 'group_tag', TAGS10, store_channel.VALUES)})"
)


def weeks_sql(value: str) -> str:
    return " + ".join(f'"{value}_{w}"' for w in ("1W", "2W", "3W"))


ROWS3_SQL = f"""
    select w.*, "units_4W" + "units_2M" + "units_3M" as cumulative_units,
      {weeks_sql('totalsales')} as three_week_sales, {weeks_sql('count_styles')} as three_week_styles,
      {weeks_sql('count_stores')} as three_week_stores, {weeks_sql('margins')} as three_week_margins,
      o.existing_1m, o.existing_2m, o.existing_3m, monthname(o.launch_date) as month
    from wide3 w left join overlap3 o on o.pattern = w.pattern and o.merchant_class = w.merchant_class"""
NUMERIC3 = [c if c[-1] != "W" else f'"{c}"' for c in store_channel.NUMERIC]
TABLE3_SQL = f"""
    select distinct a.*, case when b.color_family = 'Solid' then 'Solid' else 'FloralPattern' end as solid_flag from (
      select district, pattern, cluster, merchant_class, month, cumulative_units, {', '.join(NUMERIC3)}
      from rows3
      where "units_3W" >= 0 and "units_2W" >= 0 and "units_1W" >= 0 and three_week_sales >= 0
        and cumulative_units >= 0 and three_week_margins >= 0
        and pattern not in ('red widget', 'blue bolt')) a
    left join (select distinct pattern, merchant_class, color_family from skus) b
      on b.pattern = a.pattern and b.merchant_class = a.merchant_class"""
TABLE3_VIEWS = {**OVERLAP3_VIEWS, "wide3": WIDE10_SQL, "rows3": ROWS3_SQL, "table3": TABLE3_SQL}


def store_table(spark, root):
    base, stores_rows = stores_base(spark, root)
    launches = store_channel.pattern_launches(base, STORE)
    return store_channel.model_table_pos(
        stores_rows, launches, rel.clusters(spark, root), v.skus(spark, root), STORE)


@query("c10_model_table_pos", with_views("select * from table3", *CHAIN, **TABLE3_VIEWS))
def _(spark, root):
    return store_table(spark, root)


FITTED3 = ["cumulative_units", *store_channel.NUMERIC]


def _quoted(c: str) -> str:
    return f'"{c}"'


LOGGED3_SQL = "select * replace (" + ", ".join(
    f"ln({_quoted(c)} + 1) as {_quoted(c)}" for c in FITTED3) + ") from table3"
TAMED3_SQL = "select * replace (" + ", ".join(
    f"round(greatest(least({_quoted(c)}, (select quantile_cont({_quoted(c)}, 0.99) from logged3)), "
    f"(select quantile_cont({_quoted(c)}, 0.01) from logged3)), 6) as {_quoted(c)}" for c in FITTED3
) + ") from logged3 where cluster is not null"


@query("c10_tame", with_views(TAMED3_SQL, *CHAIN, **TABLE3_VIEWS, logged3=LOGGED3_SQL))
def _(spark, root):
    return rounded(store_channel.tame(store_table(spark, root), STORE), *FITTED3)


@query("c10_matrix")
def _(spark, root):
    m = store_channel.matrix(store_table(spark, root), STORE)
    return m.df.select(*m.ids, m.y, *m.xs)


@query("c12_train_linear_family")
def _(spark, root):
    web, pos = v.web(spark, root), v.pos(spark, root)
    skus, stores = v.master(spark, root), v.stores(spark, root)
    patterns = v.skus(spark, root).select("pattern").distinct()
    return store_channel.run(web, pos, skus, stores, patterns, STORE)["metrics"]
