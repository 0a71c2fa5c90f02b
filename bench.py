"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from resistrum.plans import registry

HEADLINES = ("antibiogram_unit", "live_cube", "priority_indicators", "denominator_cube", "first_isolates", "episode_dedup", "rates_by_unit", "latest_results", "breakpoint_readings", "daily_series", "cusum_runs", "scan_windows", "scan_clusters", "farrington_alarms", "bernoulli_locations", "text_redaction", "rare_results", "identity_lookup", "pending_dispatches", "metric_catalogue", "space_time_windows")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    registry.QUERIES[HEADLINES[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINES:
        began = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
