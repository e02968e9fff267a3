"""The given tables seen as a retailer's web lines, store lines, products and stores.

Each frame has a twin in :data:`SQL`, the same view for the SQL check.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from launchlens import operators as op
from launchlens.functions import (
    SCHEME_WEEK3,
    SCHEME_WEEK4,
    age_bucket,
    age_days,
    effective_launch,
    season_of,
    solid_flag,
)
from launchlens import sources

SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def load_table(
    spark: SparkSession, name: str, root: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """A given table, under its declared schema."""
    return sources.load_table(spark, name, root, columns, SCHEMAS[name])


MONEY = ("amount", "qty")
LINES = op.SalesSpec("sku", "sale_date", "slip", "amount", "qty", "std_cost", "retail_price")


def sales_lines(spark: SparkSession, root: str) -> DataFrame:
    lines = load_table(spark, "lineitem", root, [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
    ])
    orders = load_table(spark, "orders", root, ["o_orderkey", "o_orderdate"])
    parts = load_table(spark, "part", root, ["p_partkey", "p_retailprice"])
    sign = F.when(F.col("l_returnflag") == "R", F.lit(-1.0)).otherwise(F.lit(1.0))
    # Orders last: where both sides are shuffled, the lines come out partitioned by slip,
    # which is what cleaning groups and joins by.
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_orderkey").alias("slip"),
            F.col("l_partkey").alias("sku"),
            F.col("l_suppkey").alias("store"),
            F.col("l_linenumber").alias("line_number"),
            F.col("o_orderdate").cast("date").alias("sale_date"),
            F.when(F.col("l_orderkey") % 2 == 0, "Web").otherwise("Pos").alias("channel"),
            (F.col("l_orderkey") % 3).cast("int").alias("entry_method"),
            (sign * F.col("l_quantity")).alias("qty"),
            (sign * F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"),
            (F.col("p_retailprice") * 0.6).alias("std_cost"),
            F.col("p_retailprice").alias("retail_price"),
            F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice") * F.col("l_discount"))
            .alias("discount"),
            (F.col("l_extendedprice") * F.col("l_tax")).alias("tax"),
        )
    )


def skus(spark: SparkSession, root: str) -> DataFrame:
    key, name = F.col("p_partkey"), F.col("p_name")
    season = (
        F.when(key % 4 == 0, "S").when(key % 4 == 1, "m").when(key % 4 == 2, "F").otherwise("W")
    )
    return load_table(spark, "part", root).select(
        key.alias("sku"),
        name.alias("pattern"),
        F.col("p_brand").alias("style"),
        F.col("p_type").alias("merchant_class"),
        F.when(name.like("red%") | name.like("blue%"), "Solid")
        .when(name.like("hot%") | name.like("cold%"), "Floral").alias("color_family"),
        F.concat(season, (F.lit(95) + key % 5).cast("string")).alias("season_code"),
        F.when(key % 3 == 1, F.date_add(F.lit("1994-07-01").cast("date"), (key % 200).cast("int")))
        .when(key % 3 == 2, F.lit("2002-01-01").cast("date")).alias("launch_date"),
    )


def stores(spark: SparkSession, root: str) -> DataFrame:
    s = load_table(spark, "supplier", root, ["s_suppkey", "s_nationkey"])
    n = load_table(spark, "nation", root)
    r = load_table(spark, "region", root)
    return (
        s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").alias("store"), F.col("r_name").alias("district"),
            F.col("n_name").alias("state"),
            F.when(F.col("s_suppkey") % 4 == 0, "Outlet").otherwise("Full Line").alias("store_type"),
        )
    )


def clean(spark: SparkSession, root: str, channel: str | None = None) -> DataFrame:
    """Lines without net-return slips; a slip has one channel, so a channel is chosen before."""
    lines = sales_lines(spark, root)
    return op.drop_negative_groups(lines if channel is None else lines.filter(F.col("channel") == channel), "slip", MONEY)


def _as_web(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("channel") == "Web").select(
        "sku", F.col("sale_date").alias("order_date"),
        F.col("slip").cast("string").alias("order_number"),
        F.col("line_number").cast("double").alias("order_line_number"),
        F.col("entry_method").alias("order_entry_method"), "amount",
        F.col("std_cost").alias("standard_cost"), "retail_price",
        F.col("qty").alias("confirmed_quantity"), F.col("discount").alias("web_discount"),
    )


def _as_pos(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("channel") == "Pos").select(
        "store", "sku", "sale_date", F.col("qty").alias("sale_quantity"),
        F.col("std_cost").alias("standard_cost"), "retail_price",
        F.col("amount").alias("net_sale_amount"), F.col("discount").alias("sale_discount"),
        F.when(F.col("line_number") != 6, F.lit(0.0)).alias("misc_discount"),
        F.col("tax").alias("tax_amount"),
        F.col("slip").cast("string").alias("slip"),
        F.col("line_number").cast("string").alias("slip_line"),
    )


def raw_web(spark: SparkSession, root: str) -> DataFrame:
    return _as_web(sales_lines(spark, root))


def raw_pos(spark: SparkSession, root: str) -> DataFrame:
    return _as_pos(sales_lines(spark, root))


def web(spark: SparkSession, root: str) -> DataFrame:
    return _as_web(clean(spark, root, "Web"))


def pos(spark: SparkSession, root: str) -> DataFrame:
    return _as_pos(clean(spark, root, "Pos"))


def master(spark: SparkSession, root: str) -> DataFrame:
    """Products under the column names of the library's pipelines."""
    return skus(spark, root).withColumnRenamed("season_code", "release_season").withColumns({
        "department": F.when(F.col("sku") % 17 == 0, "Marketing").otherwise("Retail"),
    })


def aged(spark: SparkSession, root: str) -> DataFrame:
    """Clean lines with the product columns, effective launch and age of each."""
    lines = clean(spark, root)
    launch = op.launch_dates(lines, skus(spark, root), "inner")
    product = skus(spark, root).drop("launch_date").join(launch, "sku")
    return (
        lines.join(product, "sku")
        .withColumns({
            "age": age_days("sale_date", "launch_date"),
            "solid_flag": solid_flag("color_family"),
            "season": season_of("season_code"),
        })
        .withColumns({"tag9": age_bucket("age", SCHEME_WEEK3), "tag10": age_bucket("age", SCHEME_WEEK4)})
    )


def sku_daily(spark: SparkSession, root: str) -> DataFrame:
    """Both channels by SKU and day, with product columns and age buckets."""
    product = skus(spark, root)
    days = op.with_launch(op.daily_rollup(clean(spark, root), LINES, ["channel"]), product, "inner")
    age = age_days("sale_date", "launch_date")
    return op.enrich_sku(days, product, [
        "pattern", "style", "merchant_class", "color_family", "season_code",
    ]).select(
        "channel", "sku", "sale_date", "launch_date", "pattern", "style", "merchant_class",
        solid_flag("color_family").alias("solid_flag"), season_of("season_code").alias("season"),
        age_bucket(age, SCHEME_WEEK3).alias("tag9"), age_bucket(age, SCHEME_WEEK4).alias("tag10"),
        *op.MEASURES,
    )


def store_buckets(spark: SparkSession, root: str) -> DataFrame:
    """Store sales of full-line stores by SKU, store and age bucket, with master columns."""
    product = skus(spark, root)
    # The launch looks at both channels.
    daily = op.with_launch(
        op.daily_rollup(clean(spark, root), LINES, ["channel", "store"]), product, "inner"
    ).filter(F.col("channel") == "Pos").withColumn(
        "group_tag", age_bucket(age_days("sale_date", "launch_date"), SCHEME_WEEK4)
    )
    return op.enrich_sku_store(
        op.bucket_rollup(daily, ["sku", "store", "launch_date"]), product, stores(spark, root),
        ["pattern", "style", "merchant_class", "season_code", "color_family"], ["district", "state"],
    )


def bucket_tag_sql(age: str, scheme: tuple[tuple[str, int], ...]) -> str:
    whens = [f"when {age} < {scheme[0][1]} then null"]
    whens += [f"when {age} < {hi} then '{tag}'" for (tag, _), (_, hi) in zip(scheme, scheme[1:])]
    whens += [f"when {age} >= {scheme[-1][1]} then '{scheme[-1][0]}'"]
    return f"case {' '.join(whens)} end"


def money_sql(expr: str) -> str:
    """Exact sum of a money expression as a double."""
    return f"cast(cast(sum(cast(cast({expr} as varchar) as decimal(28,10))) as varchar) as double)"


def measures_sql(amount: str = "amount", qty: str = "qty", slip: str = "slip",
                 cost: str = "std_cost", price: str = "retail_price") -> str:
    return (
        f"{money_sql(amount)} as totalsales, count(distinct {slip}) as trans, "
        f"{money_sql(qty)} as units, {money_sql(f'{amount} - {cost}')} as margins, "
        f"{money_sql(f'{price} * {qty}')} as price"
    )


def resum_sql() -> str:
    return (
        f"{money_sql('totalsales')} as totalsales, cast(sum(trans) as bigint) as trans, "
        f"{money_sql('units')} as units, {money_sql('margins')} as margins, "
        f"{money_sql('price')} as price"
    )


def ratio_sql(num: str, den: str) -> str:
    return f"{money_sql(num)} / nullif({money_sql(den)}, 0)"


SEASON_SQL = (
    "case when {c} ilike 'M%' then 'Summer' when {c} ilike 'S%' then 'Spring' "
    "when {c} ilike 'W%' then 'Winter' when {c} ilike 'F%' then 'Fall' end"
)

# view name -> (views it reads, select)
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "sales_lines": ((), """
        select l_orderkey as slip, l_partkey as sku, l_suppkey as store,
          l_linenumber as line_number, cast(o_orderdate as date) as sale_date,
          case when l_orderkey % 2 = 0 then 'Web' else 'Pos' end as channel,
          cast(l_orderkey % 3 as int) as entry_method,
          case when l_returnflag = 'R' then -l_quantity else l_quantity end as qty,
          case when l_returnflag = 'R' then -1.0 else 1.0 end * l_extendedprice * (1 - l_discount) as amount,
          p_retailprice * 0.6 as std_cost, p_retailprice as retail_price,
          case when l_linenumber = 7 then null else l_extendedprice * l_discount end as discount,
          l_extendedprice * l_tax as tax
        from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey"""),
    "skus": ((), """
        select p_partkey as sku, p_name as pattern, p_brand as style, p_type as merchant_class,
          case when p_name like 'red%' or p_name like 'blue%' then 'Solid'
               when p_name like 'hot%' or p_name like 'cold%' then 'Floral' end as color_family,
          case p_partkey % 4 when 0 then 'S' when 1 then 'm' when 2 then 'F' else 'W' end
            || cast(95 + p_partkey % 5 as varchar) as season_code,
          case p_partkey % 3 when 1 then date '1994-07-01' + cast(p_partkey % 200 as int)
            when 2 then date '2002-01-01' end as launch_date
        from part"""),
    "stores": ((), """
        select s_suppkey as store, r_name as district, n_name as state,
          case when s_suppkey % 4 = 0 then 'Outlet' else 'Full Line' end as store_type
        from supplier join nation on s_nationkey = n_nationkey join region on r_regionkey = n_regionkey"""),
    "bad": (("sales_lines",), """
        select slip from sales_lines group by slip
        having sum(cast(amount as decimal(18,4))) < 0 or sum(cast(qty as decimal(18,4))) < 0"""),
    "clean": (("sales_lines", "bad"), "select * from sales_lines where slip not in (select slip from bad)"),
    "raw_web": (("sales_lines",), """
        select sku, sale_date as order_date, cast(slip as varchar) as order_number,
          cast(line_number as double) as order_line_number, entry_method as order_entry_method,
          amount, std_cost as standard_cost, retail_price, qty as confirmed_quantity,
          discount as web_discount
        from sales_lines where channel = 'Web'"""),
    "raw_pos": (("sales_lines",), """
        select store, sku, sale_date, qty as sale_quantity, std_cost as standard_cost, retail_price,
          amount as net_sale_amount, discount as sale_discount,
          case when line_number <> 6 then 0.0::double end as misc_discount, tax as tax_amount,
          cast(slip as varchar) as slip, cast(line_number as varchar) as slip_line
        from sales_lines where channel = 'Pos'"""),
    "web": (("raw_web", "bad"), "select * from raw_web where order_number not in (select cast(slip as varchar) from bad)"),
    "pos": (("raw_pos", "bad"), "select * from raw_pos where slip not in (select cast(slip as varchar) from bad)"),
    "master": (("skus",), """
        select sku, pattern, style, merchant_class, color_family, season_code as release_season, launch_date,
          case when sku % 17 = 0 then 'Marketing' else 'Retail' end as department from skus"""),
    "launches": (("clean", "skus"), """
        select f.sku, case when s.launch_date is null or s.launch_date > f.first_sale
            then f.first_sale else s.launch_date end as launch_date
        from (select sku, min(sale_date) as first_sale from clean group by sku) f
        join skus s on s.sku = f.sku"""),
    "aged": (("clean", "skus", "launches"), f"""
        select a.*, {bucket_tag_sql('age', SCHEME_WEEK3)} as tag9, {bucket_tag_sql('age', SCHEME_WEEK4)} as tag10
        from (select c.*, l.launch_date, s.pattern, s.style, s.merchant_class, s.color_family, s.season_code,
            cast(c.sale_date - l.launch_date as int) as age,
            case when s.color_family = 'Solid' then 'Solid' else 'Non-Solid' end as solid_flag,
            {SEASON_SQL.format(c='s.season_code')} as season
          from clean c join launches l on l.sku = c.sku join skus s on s.sku = c.sku) a"""),
    "sku_daily": (("aged",), f"""
        select channel, sku, sale_date, launch_date, pattern, style, merchant_class, solid_flag, season,
          tag9, tag10, {measures_sql()} from aged group by all"""),
    "store_buckets": (("aged", "stores"), f"""
        select b.*, st.district, st.state from (
          select sku, store, launch_date, pattern, style, merchant_class, season_code, color_family,
            tag10 as group_tag, {resum_sql()}
          from (select sku, store, sale_date, launch_date, pattern, style, merchant_class, season_code,
              color_family, tag10, {measures_sql()} from aged where channel = 'Pos' group by all) d
          group by all) b
        join stores st on st.store = b.store where st.store_type = 'Full Line'"""),
}


def with_views(select: str, *names: str, **extra: str) -> str:
    """The select under a WITH clause of the named views, what they read, and extra views."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for needed in SQL[name][0]:
            visit(needed)
        order.append(name)

    for name in names:
        visit(name)
    clauses = [f"{n} as ({SQL[n][1]})" for n in order] + [f"{n} as ({s})" for n, s in extra.items()]
    return f"with {', '.join(clauses)} {select}" if clauses else select


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
