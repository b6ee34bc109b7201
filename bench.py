"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH")]))

from pyspark.sql import SparkSession  # noqa: E402

from tallymark.plans.queries import QUERIES  # noqa: E402

HEADLINE = tuple(os.environ["BENCH_ONLY"].split()) if os.environ.get("BENCH_ONLY") else (
    "a1_impressions_by_campaign", "a2_impressions_by_country", "a3_hourly_trend", "a4_reach_exact", "a5_recon_summary", "a6_daily_rollup",
    "a9_native_ids", "c1_call_outcomes", "d1_fixed_window", "d2_rotation", "d3_outcomes", "d3_rotation", "f13_payload_roku", "h1_ledger_health", "j4_match_best", "p1_beacon_fields", "w1_rate_limit",
)
#: Timed runs of each query; the middle one counts, the first one has Spark's start in it.
RUNS = 3


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/events.parquet").count()
    took, first = {}, {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS):
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(round(time.perf_counter() - began, 3))
        took[name], first[name] = sorted(runs)[RUNS // 2], runs[0]
    print(json.dumps({"metric": "headline queries, median of runs", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "first_runs": first, "runs": RUNS, "sf": folder.rsplit("sf", 1)[-1].strip("/")}))


if __name__ == "__main__":
    main()
