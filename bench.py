"""Times the headline queries and prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from tidewatch.plans import catalog  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["a1_weighted_rollup", "a7_repaired_thresholds", "features", "w2_ewma", "w13_rank_in_bucket", "a12_node_profile",
            "d2_psi_all_features", "b7_evaluate_baselines", "m1_average_precision", "m7_sweep_table", "w14_memory_fill",
            "i2_live_features", "st5_debounce", "a23_fleet_summary", "st1_stream_rollup"]


def main() -> None:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.sql.shuffle.partitions", CPUS)
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
             .config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINE
    queries, times = catalog.queries(), {}
    warm = SF_DIR.rsplit("/", 1)[0] + "/sf0.001"
    if os.path.isdir(warm):
        queries["features"](spark, warm).write.format("noop").mode("overwrite").save()
    for name in chosen:
        start = time.perf_counter()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": SF_DIR.rsplit("/sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
