"""Times the headline queries on the tables in $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from fleetspan.plans import registry

HEADLINE = {
    "a01_passages": "Export all passages", "w01_headways": "Export all passages", "w05_labels": "Export all passages", "w08_irregularity": "", "m01_features": "",
    "j10_nearest_visit": "Line-day", "w13_candidates": "Line-day", "a18_episodes": "Detector output", "a20_heatmap": "",
    "a28_lines": "Build findings", "a32_departures": "Build findings", "a36_pile_ups": "Build findings", "a37_hot_areas": "Build findings",
    "j13_near_pairs": "", "r02_timeline": "", "s05_dedup": "", "s08_availability": "Date-aware catalogue query", "a25_section_speed": "", "a48_scenarios": "",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    registry.QUERIES["s08_availability"](spark, sf_dir).count()  # starts the JVM's workers
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
