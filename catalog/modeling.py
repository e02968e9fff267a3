"""Queries: scaling, clustering, redundancy, splits, models, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import relational as rel
from catalog import views as v
from catalog.registry import query, r6, rounded
from catalog.views import money_sql, with_views
from launchlens import functions as fn
from launchlens import operators as op

SCALED = ("count_sku", "count_styles", "totalsales", "units", "avg_margins", "avg_price")


@query("m1_zscore", with_views(
    "select pattern, " + ", ".join(
        f"round(({c} - avg({c}) over ()) / stddev_samp({c}) over (), 6) as {c}" for c in SCALED)
    + f" from ({rel.PROFILE_SQL})", "sku_daily"))
def _(spark, root):
    profile = op.materialize(rel.early_profile(spark, root).select("pattern", *SCALED))
    return rounded(op.zscore(profile, SCALED), *SCALED)


def scaled_profile(spark, root) -> DataFrame:
    profile = rel.early_profile(spark, root).select("pattern", *SCALED).dropna()
    return op.materialize(op.zscore(op.materialize(profile), SCALED))


@query("m2_kmeans_fit")
def _(spark, root):
    scaled = scaled_profile(spark, root)
    fit = op.kmeans_fit(scaled, SCALED, k=3, key=["pattern"])
    sizes = op.assign_clusters(scaled, fit).groupBy("cluster").agg(F.count("*").alias("n"))
    return sizes.withColumn("cost", F.lit(round(fit.cost, 6)))


@query("m3_elbow_curve")
def _(spark, root):
    return op.elbow_curve(scaled_profile(spark, root), SCALED, key=["pattern"])


ONE_CLUSTER = ("qty", "retail_price", "discount")


@query("m3_one_cluster_cost", with_views(
    "select 1 as k, round(" + " + ".join(f"var_pop({c}) * count(*)" for c in ONE_CLUSTER)
    + ", 2) as cost from clean where discount is not null", "clean"))
def _(spark, root):
    return rounded(op.one_cluster_cost(v.clean(spark, root), ONE_CLUSTER), "cost", digits=2)


# Lines by their number in the order: seven different points, so seven clusters cost nothing and are known.
SEVEN = ("line", "odd")
SEVEN_COST_SQL = (
    "select 1 as k, round(count(*) * (var_pop(l_linenumber) + var_pop(l_linenumber % 2)), 3) as cost from lineitem "
    "union all select 7, 0.0")


def numbered_lines(spark, root) -> DataFrame:
    number = F.col("l_linenumber")
    return v.load_table(spark, "lineitem", root, ["l_orderkey", "l_linenumber"]).select(
        "l_orderkey", "l_linenumber", number.cast("double").alias("line"), (number % 2).cast("double").alias("odd"))


@query("m2_kmeans_distinct", "select l_linenumber as cluster, count(*) as n, 0.0::double as cost from lineitem group by 1")
def _(spark, root):
    lines = numbered_lines(spark, root)
    fit = op.kmeans_fit(lines, SEVEN, 7)
    return op.assign_clusters(lines, fit).groupBy("cluster").agg(F.count("*").alias("n")).withColumn("cost", F.lit(fit.cost))


@query("m6_assign_distinct", "select l_orderkey, l_linenumber, l_linenumber as cluster from lineitem")
def _(spark, root):
    lines = numbered_lines(spark, root)
    return op.assign_clusters(lines, op.kmeans_fit(lines, SEVEN, 7)).select("l_orderkey", "l_linenumber", "cluster")


@query("t3_best_run", SEVEN_COST_SQL)
def _(spark, root):
    runs = op.kmeans_runs(numbered_lines(spark, root), SEVEN, (1, 7))
    costs = spark.createDataFrame([(r.k, r.start, r.cost) for r in runs], "k int, start int, cost double")
    return rounded(costs.groupBy("k").agg(F.min("cost").alias("cost")), "cost", digits=3)


@query("u5_elbow_rows", SEVEN_COST_SQL)
def _(spark, root):
    return rounded(op.elbow_curve(numbered_lines(spark, root), SEVEN, (1, 7)), "cost", digits=3)


PAIRS_SQL = """
    select a.vec_id as id, a.label as own, b.label as other, count(*) as n,
      sum(list_distance(a.embedding::double[], b.embedding::double[])) as total
    from embeddings a, embeddings b group by all"""


@query("m4_cluster_distances", f"select * replace (round(total, 6) as total) from ({PAIRS_SQL})")
def _(spark, root):
    vectors = v.load_table(spark, "embeddings", root)
    return rounded(op.cluster_distances(vectors, "vec_id", "embedding", "label"), "total")


SILHOUETTE_SQL = f"""
    with pairs as ({PAIRS_SQL}),
    a as (select id, own, case when n > 1 then total / (n - 1) end as a from pairs where own = other),
    b as (select id, min(total / n) as b, arg_min(other, total / n) as neighbor
          from pairs where own <> other group by id)
    select id as vec_id, own as cluster, neighbor,
      round(case when a is null then 0 else (b - a) / greatest(a, b) end, 6) as sil_width
    from a join b using (id)"""


@query("m5_silhouette", SILHOUETTE_SQL)
def _(spark, root):
    vectors = v.load_table(spark, "embeddings", root)
    return rounded(op.silhouette(vectors, "vec_id", "embedding", "label"), "sil_width")


@query("m6_assign_clusters")
def _(spark, root):
    scaled = scaled_profile(spark, root)
    return op.assign_clusters(scaled, op.kmeans_fit(scaled, SCALED, k=4, n_start=50, key=["pattern"])).select(
        "pattern", "cluster")


WINSORIZED = ("totalsales", "units", "margins")


@query("m7_winsorize", with_views(
    "select sku, channel, sale_date, " + ", ".join(
        f"round(case when {c} is not null then greatest(least({c}, "
        f"(select quantile_cont({c}, 0.99) from sku_daily)), (select quantile_cont({c}, 0.01) from sku_daily)) "
        f"end, 6) as {c}" for c in WINSORIZED) + " from sku_daily", "sku_daily"))
def _(spark, root):
    days = op.materialize(v.sku_daily(spark, root).select("sku", "channel", "sale_date", *WINSORIZED))
    return rounded(op.winsorize(days, WINSORIZED), *WINSORIZED)


CLASSES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


@query("m8_one_hot", with_views(
    "select sku, " + ", ".join(
        f"case when merchant_class = '{c}' then 1 else 0 end as \"merchant_class_{c}\"" for c in CLASSES)
    + ", " + ", ".join(
        f"case when color_family = '{c}' then 1 else 0 end as \"color_family_{c}\"" for c in ("Floral", "Solid"))
    + " from skus", "skus"))
def _(spark, root):
    coded, _ = op.one_hot(v.skus(spark, root).select("sku", "merchant_class", "color_family"),
                          ["merchant_class", "color_family"])
    return coded


def coded_lines(spark, root) -> tuple[DataFrame, list[str]]:
    """Lines with two full sets of dummies, so each set adds up to the intercept."""
    lines = v.aged(spark, root).select(
        "qty", "amount", "retail_price", "std_cost", "channel", "merchant_class", "solid_flag")
    coded, dummies = op.one_hot(op.materialize(lines), ["channel", "merchant_class", "solid_flag"])
    return coded, ["qty", "amount", "retail_price", "std_cost", *dummies]


@query("m9_drop_linear_combos")
def _(spark, root):
    coded, cols = coded_lines(spark, root)
    names = [(c,) for c in op.linear_combos(coded, cols)]
    return spark.createDataFrame(names, "dropped string")


# Two columns that say nothing new beside quantity, amount and price: one is made of the first two.
PLANTED = {"qty": "qty", "amount": "amount", "made": "3 * qty - amount / 1000", "seven": "qty * 0 + 7", "retail_price": "retail_price"}


def left_share(col: str) -> str:
    """What quantity and amount leave of a column's variance, as a share of it."""
    return (f"1 - (var_pop(amount) * covar_pop({col}, qty) * covar_pop({col}, qty) + var_pop(qty) * covar_pop({col}, amount) * covar_pop({col}, amount)"
            f" - 2 * covar_pop(qty, amount) * covar_pop({col}, qty) * covar_pop({col}, amount))"
            f" / (var_pop(qty) * var_pop(amount) - power(covar_pop(qty, amount), 2)) / var_pop({col})")


@query("m9_linear_combos_planted", with_views(f"""
    select dropped from (
      select 'made' as dropped, {left_share('made')} as rest from planted
      union all select 'retail_price', {left_share('retail_price')} from planted
      union all select 'seven', var_pop(seven) from planted) where rest <= 1e-6""",
    "clean", planted=f"select {', '.join(f'{e} as {c}' for c, e in PLANTED.items())} from clean"))
def _(spark, root):
    lines = op.materialize(v.clean(spark, root).selectExpr(*[f"{e} as {c}" for c, e in PLANTED.items()]))
    return spark.createDataFrame([(c,) for c in op.linear_combos(lines, list(PLANTED))], "dropped string")


NZV = ("l_linenumber", "l_quantity", "l_discount", "l_tax", "l_suppkey", "one")


def nzv_sql(col: str) -> str:
    source = "1" if col == "one" else col
    return f"""
      select '{col}' as "column", n_unique, round(case when n_unique = 1 then 0 else top / second end, 6) as freq_ratio,
        round(100.0 * n_unique / total, 6) as percent_unique from (
          select count(*) as n_unique, sum(n) as total, max(n) as top,
            max(case when place = 2 then n end)::double as second
          from (select n, row_number() over (order by n desc) as place
            from (select {source} as v, count(*) as n from lineitem group by 1)))"""


@query("m10_near_zero_var", f"""
    select "column", freq_ratio, percent_unique, n_unique = 1 as zero_var,
      n_unique = 1 or (freq_ratio > 19 and percent_unique <= 10) as nzv
    from ({' union all '.join(nzv_sql(c) for c in NZV)})""")
def _(spark, root):
    lines = v.load_table(spark, "lineitem", root).withColumn("one", F.lit(1))
    return rounded(op.near_zero_var(lines, NZV), "freq_ratio", "percent_unique")


CORRELATED = ("qty", "amount", "retail_price", "std_cost", "tax")


@query("m11_correlation_pairs", with_views(
    " union all ".join(
        f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as corr from clean"
        for i, a in enumerate(CORRELATED) for b in CORRELATED[i + 1:]), "clean"))
def _(spark, root):
    return rounded(op.correlation_pairs(v.clean(spark, root), CORRELATED), "corr")


@query("m11_correlation_filter")
def _(spark, root):
    dropped = op.correlation_filter(v.clean(spark, root), CORRELATED, 0.85)
    return spark.createDataFrame([(c,) for c in dropped], "dropped string")


SKU_SALES_SQL = f"select sku, {money_sql('amount')} as y from clean group by sku"


def sku_sales(spark, root) -> DataFrame:
    return op.materialize(v.clean(spark, root).groupBy("sku").agg(fn.exact_sum("amount").alias("y")))


STRATA_SQL = """
    select sku, y, (y > q[2])::int + (y > q[3])::int + (y > q[4])::int as stratum
    from sku_sales, (select quantile_cont(y, [0, 0.25, 0.5, 0.75, 1]) as q from sku_sales)"""


@query("m12_stratified_split", with_views(f"""
    select sku, y, row_number() over (partition by stratum order by md5('1234|' || sku))
        <= ceil(0.7::double * count(*) over (partition by stratum)) as is_train
    from ({STRATA_SQL})""", "clean", sku_sales=SKU_SALES_SQL))
def _(spark, root):
    return op.stratified_split(sku_sales(spark, root), "y", ["sku"], 0.7, seed=1234)


@query("m13_assign_folds", with_views(
    "select sku, y, cast((row_number() over (order by md5('1234|' || sku)) - 1) % 5 as int) as fold from sku_sales",
    "clean", sku_sales=SKU_SALES_SQL))
def _(spark, root):
    return op.assign_folds(sku_sales(spark, root), 5, ["sku"], 1234)


@query("m13_assign_folds_strata", with_views(f"""
    select sku, y, cast((row_number() over (partition by stratum order by md5('7|' || sku)) - 1) % 10 as int)
      as fold from ({STRATA_SQL})""", "clean", sku_sales=SKU_SALES_SQL))
def _(spark, root):
    return op.assign_folds(sku_sales(spark, root), 10, ["sku"], 7, y="y")


@query("m14_fit_linear_one", with_views("""
    select round(regr_intercept(amount, qty), 4) as intercept, round(regr_slope(amount, qty), 4) as slope,
      round(regr_r2(amount, qty), 6) as r2 from clean""", "clean"))
def _(spark, root):
    fit = op.fit_linear(op.materialize(v.clean(spark, root).select("amount", "qty")), "amount", ["qty"])
    row = (round(fit.intercept, 4), round(fit.coefs["qty"], 4), round(fit.summary.r2, 6))
    return spark.createDataFrame([row], "intercept double, slope double, r2 double")


def model_sums(spark, root) -> DataFrame:
    """SKU rows: sales after day 90, the earlier buckets, days and prices."""
    days = v.sku_daily(spark, root)
    early = F.col("tag9").isin("1W", "2W", "3W", "2M", "3M")
    keys = ["sku", "merchant_class", "solid_flag"]
    return op.dealt(days, *keys).groupBy(*keys).agg(
        fn.exact_sum(F.when(early, F.col("totalsales")).otherwise(0.0)).alias("early_sales"),
        fn.exact_sum(F.when(early, F.col("units")).otherwise(0.0)).alias("early_units"),
        fn.exact_sum(F.when(~early, F.col("units")).otherwise(0.0)).alias("y"),
        F.count_distinct("sale_date").alias("days"),
        fn.ratio_of_sums("price", "units").alias("avg_price"),
    ).dropna()


def model_rows(spark, root, k: int = 5) -> tuple[DataFrame, str, list[str]]:
    """SKU rows with folds: sales after day 90 from the earlier buckets, products and prices."""
    rows = model_sums(spark, root)
    coded, dummies = op.one_hot(op.materialize(rows), ["merchant_class", "solid_flag"])
    xs = ["early_sales", "early_units", "days", "avg_price", *dummies[1:-2], dummies[-1]]
    return op.materialize(op.assign_folds(coded, k, ["sku"], 1234)), "y", xs


@query("m14_fit_linear_summary")
def _(spark, root):
    rows, y, xs = model_rows(spark, root)
    table = op.linear_summary(rows, op.fit_linear(rows, y, xs))
    return rounded(table, "estimate", "std_error", "t", "p")


@query("m14_fit_linear_folds")
def _(spark, root):
    rows, y, xs = model_rows(spark, root)
    return op.fit_linear(rows, y, xs, fold="fold").resampled


SKU_UNITS_SQL = f"""
    select sku, {money_sql('amount')} as y, {money_sql('qty')} as x from clean group by sku"""
FOLDS_SQL = """
    select sku, y, x, cast((row_number() over (order by md5('1234|' || sku)) - 1) % 5 as int) as fold
    from sku_units"""


def sku_units(spark, root) -> DataFrame:
    rows = v.clean(spark, root).groupBy("sku").agg(
        fn.exact_sum("amount").alias("y"), fn.exact_sum("qty").alias("x"))
    return op.materialize(op.assign_folds(op.materialize(rows), 5, ["sku"], 1234))


@query("m14_fit_linear_folds_one", with_views("""
    select f.fold, round(sqrt(avg(power(y - b0 - b1 * x, 2))), 3) as rmse,
      round(power(corr(y, b0 + b1 * x), 2), 6) as r2, round(avg(abs(y - b0 - b1 * x)), 3) as mae
    from (select h.fold, regr_intercept(t.y, t.x) as b0, regr_slope(t.y, t.x) as b1
        from (select distinct fold from folds) h join folds t on t.fold <> h.fold group by h.fold) f
      join folds r on r.fold = f.fold
    group by f.fold""", "clean", sku_units=SKU_UNITS_SQL, folds=FOLDS_SQL))
def _(spark, root):
    held = op.fit_linear(sku_units(spark, root), "y", ["x"], fold="fold").resampled
    return rounded(rounded(held, "rmse", "mae", digits=3), "r2")


SKU_TWO_SQL = f"""
    select sku, {money_sql('amount')} as y, {money_sql('qty')} as x, count(*)::double as z from clean group by sku"""
TWO_FOLDS_SQL = FOLDS_SQL.replace("y, x,", "y, x, z,").replace("sku_units", "sku_two")
# Least squares on two columns, from variances and covariances by group.
TWO_SUMS = """count(*) as n, avg(x) as mx, avg(z) as mz, avg(y) as my, var_pop(x) as vx, var_pop(z) as vz, var_pop(y) as vy,
    covar_pop(x, z) as cxz, covar_pop(x, y) as cxy, covar_pop(z, y) as czy"""
TWO_SLOPES = """*, vx * vz - cxz * cxz as det, (vz * cxy - cxz * czy) / (vx * vz - cxz * cxz) as bx,
    (vx * czy - cxz * cxy) / (vx * vz - cxz * cxz) as bz"""
TWO = {"sku_two": SKU_TWO_SQL, "folds": TWO_FOLDS_SQL, "fits": f"""
    select {TWO_SLOPES}, my - bx * mx - bz * mz as b0, n * (vy - bx * cxy - bz * czy) as rss
    from (select h.fold, {TWO_SUMS} from (select distinct fold from folds) h join folds t on t.fold <> h.fold
      group by h.fold)"""}


def sku_two(spark, root) -> DataFrame:
    rows = v.clean(spark, root).groupBy("sku").agg(
        fn.exact_sum("amount").alias("y"), fn.exact_sum("qty").alias("x"), F.count("*").cast("double").alias("z"))
    return op.materialize(op.assign_folds(op.materialize(rows), 5, ["sku"], 1234))


@query("m14_fit_linear_folds_two", with_views("""
    select f.fold, round(sqrt(avg(power(y - b0 - bx * x - bz * z, 2))), 3) as rmse,
      round(power(corr(y, b0 + bx * x + bz * z), 2), 6) as r2, round(avg(abs(y - b0 - bx * x - bz * z)), 3) as mae
    from fits f join folds r on r.fold = f.fold group by f.fold""", "clean", **TWO))
def _(spark, root):
    held = op.fit_linear(sku_two(spark, root), "y", ["x", "z"], fold="fold").resampled
    return rounded(rounded(held, "rmse", "mae", digits=3), "r2")


@query("m14_fold_summary", with_views("""
    select fold, n, term, round(estimate, 3) as estimate, round(std_error, 3) as std_error, round(estimate / std_error, 4) as t
    from (
      select fold, n, 'x' as term, bx as estimate, sqrt(rss / (n - 3) * vz / (n * det)) as std_error from fits
      union all select fold, n, 'z', bz, sqrt(rss / (n - 3) * vx / (n * det)) from fits
      union all select fold, n, '(Intercept)', b0,
        sqrt(rss / (n - 3) * (1 + (mx * mx * vz + mz * mz * vx - 2 * mx * mz * cxz) / det) / n) from fits)""", "clean", **TWO))
def _(spark, root):
    rows = sku_two(spark, root)
    table = op.fold_summary(rows, op.fit_linear(rows, "y", ["x", "z"], fold="fold")).drop("p")
    return rounded(rounded(table, "estimate", "std_error", digits=3), "t", digits=4)


SHARES = (0.9, 0.5, 0.1, 0.01)
# The path has one bend on two columns: alone up to it is the column that pulls more, then both move to least squares.
LASSO_TWO_SQL = f"""
    select share, round(wx / sqrt(n * vx), 5) as x, round(wz / sqrt(n * vz), 5) as z,
      round(my - mx * wx / sqrt(n * vx) - mz * wz / sqrt(n * vz), 2) as intercept
    from (select *, case when x_first then own else other end as wx, case when x_first then other else own end as wz
      from (select *, s * case when goal <= bend then goal else bend + (goal - bend) / (size - bend) * (s * la - bend) end as own,
          case when goal <= bend then 0 else (goal - bend) / (size - bend) * lb end as other
        from (select *, share * size as goal
          from (select *, least((abs(ca) - cb) / (1 - s * r), (abs(ca) + cb) / (1 + s * r)) as bend, abs(la) + abs(lb) as size
            from (select *, sign(ca) as s, (ca - r * cb) / (1 - r * r) as la, (cb - r * ca) / (1 - r * r) as lb
              from (select *, case when x_first then cx else cz end as ca, case when x_first then cz else cx end as cb
                from (select *, abs(cx) >= abs(cz) as x_first
                  from (select *, cxz / sqrt(vx * vz) as r, n * cxy / sqrt(n * vx) as cx, n * czy / sqrt(n * vz) as cz
                    from (select {TWO_SUMS} from sku_two))))), (select unnest({list(SHARES)})::double as share)))))"""


@query("m15_lasso_shares", with_views(LASSO_TWO_SQL, "clean", sku_two=SKU_TWO_SQL))
def _(spark, root):
    rows = sku_two(spark, root)
    out = []
    for share in SHARES:
        fit = op.fit_lasso(rows, "y", ["x", "z"], fractions=[share])
        out.append((share, round(fit.coefs["x"], 5), round(fit.coefs["z"], 5), round(fit.intercept, 2)))
    return spark.createDataFrame(out, "share double, x double, z double, intercept double")


@query("m15_lasso_path")
def _(spark, root):
    rows, y, xs = model_rows(spark, root)
    return rounded(op.lasso_path(rows, y, xs), "share", "estimate")


@query("m16_fit_step_aic_two", with_views(f"""
    select case when least(ax, az, axz) > a0 then '' when axz <= least(ax, az) then 'x,z'
        when a0 < least(ax, az) then '' when ax < az then 'x' else 'z' end as terms,
      round(case when least(ax, az, axz) > a0 then a0 when axz <= least(ax, az) then axz else least(a0, ax, az) end, 4) as aic
    from (select n * ln(vy) + 2 as a0, n * ln(vy - cxy * cxy / vx) + 4 as ax, n * ln(vy - czy * czy / vz) + 4 as az,
        n * ln(vy - bx * cxy - bz * czy) + 6 as axz
      from (select {TWO_SLOPES} from (select {TWO_SUMS} from sku_two)))""", "clean", sku_two=SKU_TWO_SQL))
def _(spark, root):
    fit = op.fit_step_aic(sku_two(spark, root), "y", ["x", "z"])
    return spark.createDataFrame([(",".join(fit.coefs), round(fit.tuning["aic"], 4))], "terms string, aic double")


@query("m20_score_one", with_views("""
    select sku, round((select regr_intercept(y, x) from sku_units)
      + (select regr_slope(y, x) from sku_units) * x, 3) as prediction
    from sku_units""", "clean", sku_units=SKU_UNITS_SQL))
def _(spark, root):
    rows = sku_units(spark, root)
    out = op.fit_linear(rows, "y", ["x"]).predict(rows).select("sku", "prediction")
    return rounded(out, "prediction", digits=3)


@query("m16_fit_step_aic_one", with_views("""
    select round(count(*) * ln(regr_syy(y, x) * (1 - regr_r2(y, x)) / count(*)) + 4, 4) as aic
    from sku_units""", "clean", sku_units=SKU_UNITS_SQL))
def _(spark, root):
    fit = op.fit_step_aic(sku_units(spark, root), "y", ["x"])
    return spark.createDataFrame([(round(fit.tuning["aic"], 4),)], "aic double")


@query("m15_fit_lasso")
def _(spark, root):
    rows, y, xs = model_rows(spark, root)
    fit = op.fit_lasso(rows, y, xs, fold="fold")
    return spark.createDataFrame(
        [(n, round(b, 6), fit.tuning["fraction"]) for n, b in fit.coefs.items()],
        "term string, estimate double, fraction double")


@query("m16_fit_step_aic")
def _(spark, root):
    rows, y, xs = model_rows(spark, root)
    fit = op.fit_step_aic(rows, y, xs, fold="fold")
    return spark.createDataFrame(
        [(n, round(b, 6), round(fit.tuning["aic"], 6)) for n, b in fit.coefs.items()],
        "term string, estimate double, aic double")


def tree_report(rows, y, model) -> DataFrame:
    """Metrics on the fitted rows and, by fold, on those held out."""
    fitted = op.regression_metrics(op.obs_pred(model.transform(rows), y, "prediction", None))
    return fitted.select(F.lit("fitted").alias("part"), F.lit(None).cast("int").alias("fold"), "rmse", "r2", "mae").unionByName(
        model.resampled.select(F.lit("held out").alias("part"), "fold", "rmse", "r2", "mae"))


@query("m17_fit_forest")
def _(spark, root):
    rows, y, xs = model_rows(spark, root)
    return tree_report(rows, y, op.fit_forest(rows, y, xs, "fold"))


@query("m17_tuning")
def _(spark, root):
    rows, y, xs = model_rows(spark, root)
    return op.fit_forest(rows, y, xs, "fold").tuning


@query("m18_fit_boosted")
def _(spark, root):
    rows, y, xs = model_rows(spark, root)
    return tree_report(rows, y, op.fit_boosted(rows, y, xs, fold="fold"))


@query("m19_fit_bagged")
def _(spark, root):
    rows, y, xs = model_rows(spark, root)
    return tree_report(rows, y, op.fit_bagged(rows, y, xs, "fold"))


# A column of two values: a tree without drawn rows has one cut, and its leaves are the group means.
ONE_CUT = {"rounds": 1, "depth": 1, "step": 1.0, "gamma": 0.0, "columns": 1.0, "row_share": 1.1, "min_rows": 1, "penalty": 0.0}


@query("m18_one_cut", """
    select p_partkey, round(avg(p_retailprice) over (partition by p_size > 25), 4) as prediction from part""")
def _(spark, root):
    parts = v.load_table(spark, "part", root, ["p_partkey", "p_size", "p_retailprice"]).withColumn("large", (F.col("p_size") > 25).cast("int"))
    model = op.fit_boosted(parts, "p_retailprice", ["large"], ONE_CUT)
    return rounded(model.transform(parts).select("p_partkey", "prediction"), "prediction", digits=4)


@query("m20_score")
def _(spark, root):
    rows, y, xs = model_rows(spark, root)
    return op.fit_linear(rows, y, xs).predict(rows).select("sku", "y", "prediction")


METRICS_SQL = """
    round(sqrt(avg(power(amount - value, 2))), 4) as rmse, round(power(corr(amount, value), 2), 6) as r2,
    round(avg(abs(amount - value)), 4) as mae"""


def with_value(spark, root):
    return v.clean(spark, root).withColumn("value", fn.line_value("retail_price", "qty"))


@query("m21_regression_metrics", with_views(
    f"select {METRICS_SQL} from (select amount, retail_price * qty as value from clean)", "clean"))
def _(spark, root):
    out = op.regression_metrics(with_value(spark, root), "amount", "value")
    return rounded(rounded(out, "rmse", "mae", digits=4), "r2")


@query("m22_regression_metrics_parts", with_views(
    f"select channel, {METRICS_SQL} from (select channel, amount, retail_price * qty as value from clean) "
    "group by channel", "clean"))
def _(spark, root):
    out = op.regression_metrics(with_value(spark, root), "amount", "value", ["channel"])
    return rounded(rounded(out, "rmse", "mae", digits=4), "r2")


@query("m23_importance")
def _(spark, root):
    rows, y, xs = model_rows(spark, root)
    linear = op.importance(rows, op.fit_linear(rows, y, xs), top=10)
    trees = op.importance(rows, op.fit_bagged(rows, y, xs), top=10)
    return reduce(DataFrame.unionByName, [
        linear.withColumn("model", F.lit("linear")), trees.withColumn("model", F.lit("bagged"))])


@query("m24_obs_pred", """
    select l_orderkey, round(exp(l_discount), 6) as obs, round(exp(l_tax), 6) as pred from lineitem""")
def _(spark, root):
    pairs = op.obs_pred(v.load_table(spark, "lineitem", root), "l_discount", "l_tax", keep=["l_orderkey"])
    return pairs.select("l_orderkey", r6("obs").alias("obs"), r6("pred").alias("pred"))
