import datetime as dt

from launchlens import operators as op

D = dt.date
SF = "/root/testdata/sf0.001"
MEASURES = "totalsales double, trans long, units double, margins double, price double"


def test_trans_is_a_number_of_slip_days(frame):
    # One slip on two days and two stores: each rollup row counts it once, sums count it again.
    rows = [("s1", 1, 10, D(2019, 1, 1)), ("s1", 1, 10, D(2019, 1, 1)), ("s1", 1, 10, D(2019, 1, 2)),
            ("s1", 1, 11, D(2019, 1, 1))]
    df = frame([(*r, 2.0, 1.0, 0.5, 3.0) for r in rows],
               "slip string, sku int, store int, sale_date date, net_sale_amount double, "
               "sale_quantity double, standard_cost double, retail_price double")
    days = op.daily_rollup(df, op.POS_SPEC, ["store"])
    assert days.count() == 3 and {r.trans for r in days.collect()} == {1}
    total = op.rollup_to(days, ["sku"]).first()
    assert (total.trans, total.units, total.margins, total.price) == (3, 4.0, 6.0, 12.0)


def test_launch_dates_how(frame):
    sales = frame([(1, D(2019, 3, 1)), (2, D(2019, 3, 1))], "sku int, sale_date date")
    skus = frame([(1, D(2019, 2, 1))], "sku int, launch_date date")
    left = {r.sku: r.launch_date for r in op.launch_dates(sales, skus).collect()}
    assert left == {1: D(2019, 2, 1), 2: D(2019, 3, 1)}
    assert op.launch_dates(sales, skus, "inner").count() == 1


def test_with_launch_equals_the_join(frame):
    days = frame([(1, D(2019, 3, 2)), (1, D(2019, 3, 1)), (2, D(2019, 3, 1)), (3, D(2019, 3, 5)), (None, D(2019, 1, 1))],
                 "sku int, sale_date date")
    skus = frame([(1, D(2019, 2, 1)), (3, D(2020, 1, 1))], "sku int, launch_date date")
    got = [(r.sku, r.launch_date) for r in op.with_launch(days, skus).collect()]
    assert sorted(got, key=str) == [
        (1, D(2019, 2, 1)), (1, D(2019, 2, 1)), (2, D(2019, 3, 1)), (3, D(2019, 3, 5)), (None, None)]
    joined = op.enrich(days, op.launch_dates(days, skus), "sku", ["launch_date"])
    assert sorted(((r.sku, r.launch_date) for r in joined.collect()), key=str) == sorted(got, key=str)
    assert op.with_launch(days, skus, "inner").count() == 3


def test_a_hot_sku_is_rolled_up_before_it_is_gathered(spark):
    # One SKU has most lines: the rows that reach the per-SKU window are its days, not its lines.
    lines = spark.range(30_000).selectExpr(
        "if(id % 3 > 0, 7, id % 50) as sku", "date_add(date'2019-01-01', cast(id % 10 as int)) as sale_date",
        "cast(id % 500 as string) as slip", "1.0d as net_sale_amount", "1.0d as sale_quantity",
        "0.5d as standard_cost", "2.0d as retail_price")
    days = op.daily_rollup(lines, op.POS_SPEC)
    assert days.filter("sku = 7").count() == 10
    skus = spark.createDataFrame([(i, None) for i in range(50)], "sku long, launch_date date")
    out = op.with_launch(days, skus)
    assert out.agg({"units": "sum"}).first()[0] == 30_000
    assert {str(r.launch_date) for r in out.filter("sku = 7").collect()} == {"2019-01-01"}


def test_combine_channels(frame):
    schema = f"sku int, sale_date date, launch_date date, {MEASURES}"
    day, launch = D(2019, 1, 5), D(2019, 1, 1)
    web = frame([(0, day, launch, 1.0, 1, 1.0, 1.0, 1.0), (1, day, launch, 1.0, 1, 1.0, 1.0, 0.0),
                 (2, day, launch, 1.0, 1, 1.0, 1.0, 5.0)], schema)
    pos = frame([(2, day, D(2019, 1, 3), 1.0, 2, 1.0, 1.0, 5.0), (2, day, launch, 1.0, 2, 1.0, 1.0, 5.0)], schema)
    got = {r.channel: r for r in op.combine_channels(web, pos).collect()}
    assert set(got) == {"Web", "Pos"}
    assert got["Pos"].trans == 4 and got["Pos"].launch_date == launch and got["Web"].sku == 2


def test_append_channels_distinct_or_all(frame):
    web = frame([("WEB", 1, 2.0)] * 2, "channel string, sku int, price double")
    pos = frame([("POS", 1, 2.0, 7), ("POS", 1, 2.0, 8)], "channel string, sku int, price double, store int")
    distinct = op.append_channels(web, pos)
    assert distinct.count() == 3 and distinct.columns == ["channel", "sku", "price", "store"]
    assert op.append_channels(web, pos, distinct=False).count() == 4


def test_color_family_may_split_a_row(frame):
    df = frame([("p", "c", 1), ("q", "c", 1)], "pattern string, merchant_class string, x int")
    skus = frame([(1, "p", "c", "Solid"), (2, "p", "c", "Solid"), (3, "p", "c", None)],
                 "sku int, pattern string, merchant_class string, color_family string")
    got = sorted((r.pattern, str(r.color_family)) for r in op.attach_color_family(df, skus).collect())
    assert got == [("p", "None"), ("p", "Solid"), ("q", "None")]


def test_enrich_sku_store_drops_other_store_types(frame):
    df = frame([(1, 10), (1, 11), (1, 12), (2, 10)], "sku int, store int")
    skus = frame([(1, "p")], "sku int, pattern string")
    stores = frame([(10, "West", "Full Line"), (11, "West", "Outlet")],
                   "store int, district string, store_type string")
    got = op.enrich_sku_store(df, skus, stores, ["pattern"], ["district"]).collect()
    assert sorted((r.sku, str(r.pattern)) for r in got) == [(1, "p"), (2, "None")]


def test_restrict_to_a_list_with_repeats(frame):
    df, keys = frame([("a",), ("b",)], "pattern string"), frame([("a",), ("a",)], "pattern string")
    assert op.restrict_to(df, keys).count() == 1
    assert op.restrict_to(df, keys, distinct_keys=False).count() == 2


def test_top_patterns_breaks_ties_by_name(frame):
    df = frame([("b", 5.0), ("a", 5.0), ("c", 9.0), ("d", 1.0)], "pattern string, totalsales double")
    assert [r.pattern for r in op.top_patterns(df, 2).collect()] == ["c", "a"]


def test_pattern_daily_takes_one_launch_per_pattern_class_channel(frame):
    rows = [("Web", "p", "c", "Solid", D(2019, 1, 9), D(2019, 1, 5)),
            ("Web", "p", "c", "Non-Solid", D(2019, 1, 9), D(2019, 1, 2)),
            ("Pos", "p", "c", "Solid", D(2019, 1, 9), D(2019, 1, 7))]
    df = frame([(*r, 1.0, 1.0, 1.0, 1.0) for r in rows],
               "channel string, pattern string, merchant_class string, solid_flag string, sale_date date, "
               "launch_date date, totalsales double, units double, margins double, price double")
    got = {(r.channel, r.solid_flag): r.launch_date for r in op.pattern_daily(df).collect()}
    assert got == {("Web", "Solid"): D(2019, 1, 2), ("Web", "Non-Solid"): D(2019, 1, 2),
                   ("Pos", "Solid"): D(2019, 1, 7)}


def test_pivot_keeps_ids_apart_and_zero_fill_is_listed_only(frame):
    df = frame([("p", D(2019, 1, 1), "1W", 5.0), ("p", D(2019, 1, 2), "2W", 7.0), ("q", D(2019, 1, 1), "4M", 1.0)],
               "pattern string, launch_date date, tag string, units double")
    wide = op.pivot_wide(df, ["pattern", "launch_date"], "tag", ["1W", "2W", "4M"], ["units"])
    got = {(r[0], r[1]): tuple(r)[2:] for r in op.zero_fill(wide, ["units_1W", "units_2W"]).collect()}
    assert got == {("p", D(2019, 1, 1)): (5.0, 0.0, None), ("p", D(2019, 1, 2)): (0.0, 7.0, None),
                   ("q", D(2019, 1, 1)): (0.0, 0.0, 1.0)}
    total = op.add_cumulative(wide, "all", ["units_1W", "units_2W"])
    assert [r["all"] for r in total.collect()] == [None, None, None]


def test_impute_early(frame):
    rows = [("Web", "early", D(2017, 5, 1), 0.0, 0.0), ("Web", "on", D(2017, 5, 2), 9.0, 9.0),
            ("Web", "after", D(2017, 5, 3), 1.0, 10.0), ("Web", "later", D(2017, 6, 3), 2.0, 20.0),
            ("Pos", "lonely", D(2017, 5, 1), 4.0, 4.0)]
    df = frame(rows, "channel string, name string, launch_date date, n double, price double")
    rule = [op.ImputeRule("2017-05-02", "n", "price")]
    got = {r["name"]: (r.n, r.price) for r in op.impute_early(df, ["channel"], rule).collect()}
    assert got == {"early": (2.0, 15.0), "on": (2.0, 15.0), "after": (1.0, 10.0),
                   "later": (2.0, 20.0), "lonely": (None, None)}
    kept = {r["name"]: r.n for r in op.impute_early(df, ["channel"], rule, fallback=True).collect()}
    assert kept["lonely"] == 4.0


def test_launch_dates_need_no_window(frame):
    from datetime import date

    days = frame([(1, date(2020, 1, 5), 1.0), (1, date(2020, 1, 3), 2.0), (2, date(2020, 2, 1), 1.0), (None, date(2020, 2, 2), 1.0)],
                 "sku int, sale_date date, units double")
    skus = frame([(1, date(2020, 1, 4))], "sku int, launch_date date")
    out = op.with_launch(days, skus)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted(((r.sku, r.launch_date) for r in out.collect()), key=str)
    assert got == sorted([(1, date(2020, 1, 3)), (1, date(2020, 1, 3)), (2, date(2020, 2, 1)), (None, None)], key=str)


def test_rollups_of_days_are_dealt_into_all_partitions(spark):
    """Adaptive execution would merge these few rows, and any rows up to its advisory size, into one task."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    days = spark.range(40).selectExpr(
        "id as sku", "date'2020-01-01' as sale_date", "date'2020-01-01' as launch_date", "false as discount_flag", "'1W' as group_tag",
        "1.5 as totalsales", "1L as trans", "2.0 as units", "0.5 as margins", "3.0 as price")
    both = op.combine_channels(days.drop("group_tag", "discount_flag"), days.drop("group_tag", "discount_flag"))
    assert both.rdd.getNumPartitions() == partitions and both.count() == 79
    buckets = op.bucket_rollup(days.unionByName(days))
    assert buckets.rdd.getNumPartitions() == partitions and {r.units for r in buckets.collect()} == {4.0}


def shuffled_joins_plan(spark, build):
    """The plan of a frame where no table is small enough to be sent to all tasks."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return build()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_model_rows_are_summed_in_a_stage_of_their_own(spark):
    from catalog import modeling

    # Days are joined by SKU: a deal by SKU alone would be left out of the plan.
    plan = shuffled_joins_plan(spark, lambda: modeling.model_sums(spark, SF))
    assert plan.count("REPARTITION_BY_NUM") == 1


def test_district_days_are_summed_in_a_stage_of_their_own(spark):
    from catalog import workflows

    plan = shuffled_joins_plan(spark, lambda: workflows.two_sku_daily(spark, SF))
    deals = [line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line]
    assert len(deals) == 2 and sum("district" in line for line in deals) == 1
