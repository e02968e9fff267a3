"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the threads, ``BENCH_RUNS``
the timed runs after one warm-up (their median counts), ``BENCH_QUERIES`` a
comma list to time instead of the headline ones, or ``all``.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = (
    "j1_drop_negative_groups", "a3_daily_rollup_web", "a6_daily_rollup_pos_flag", "a8_combine_channels",
    "a12_pattern_profile", "a13_pattern_district_profile", "a16_model_aggregate", "t1_top_patterns",
    "j8_enrich_sku_store", "j11_launch_overlap_counts", "j12_launch_overlap_metrics", "r1_pivot_wide",
    "m5_silhouette", "m7_winsorize", "m12_stratified_split", "m14_fit_linear_folds", "c2_build_sku_daily",
    "c9_model_table",
)


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from catalog import QUERIES

    names = HEADLINE if not chosen else tuple(QUERIES) if chosen == "all" else tuple(chosen.split(","))

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(root).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
