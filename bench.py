"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "interval_enrich", "period_stats", "asof_backward_by_unit", "merge_outer", "describe", "outliers", "corr_matrix",
    "quantiles_by_group", "group_hourly", "dup_rows", "column_profile", "lag_features", "rolling_mean_partial", "time_rolling",
    "ffill_by_unit", "interpolate_linear", "segments_by_equipment", "resample_hourly", "create_features", "ridge_matrix",
    "autocorr", "change_points", "decompose", "periodogram", "histogram", "standardize", "gd_history", "ridge_cv",
    "isolation_forest", "kmeans_sizes", "contact_cards_documents", "stream_enrich",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus))).config("spark.driver.memory", "5g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tagloom.catalogue import QUERIES

    names = sys.argv[1:] or HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    times = {}
    for name in names:
        spent = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - start)
        times[name] = round(statistics.median(spent[1:] or spent), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
