"""Time the headline queries; prints one JSON line.

Each query runs twice and the second run counts, so that compiling generated
code is not measured.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# One query per theme: scan, load, quality, failures, mobility, active devices, flow, features.
HEADLINE = (
    "pcmd_scan",
    "bearer_load",
    "agg_load",
    "top_volatile_trace",
    "failure_rate_rolling",
    "bler_mean",
    "failure_causes",
    "distinct_bs",
    "handover_cdf",
    "handover_load",
    "neighbor_counts",
    "last_record",
    "active_load",
    "mean_active_load",
    "ue_timeline",
    "ue_arrivals",
    "neighbor_flow",
    "presence_flow",
    "feature_summary",
    "bs_features",
    "handover_timeline",
    "stream_counts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cellpulse-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from cellpulse.catalog import QUERIES

    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": cpus,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
