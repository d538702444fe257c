"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import time

from tallyforge import plans
from tallyforge.session import local_session

HEADLINE = [
    "t3_top_functions", "a1_function_stats", "j3_latest_enter_exit", "a3_cpu_stats", "a5_io_by_process", "a7_memory_stats",
    "a8_net_stats", "w5_memory_timeline", "w7_io_spikes", "w9_traffic_bursts", "d8_fragmentation_metrics", "d1_leak_scores",
    "w15_scaled", "w11_mean_distance", "m8_sliding_threshold", "j5_calls", "j6_events_in_calls", "j11_same_level_pairs",
    "w1_attribute_states", "i7_containment", "i14_cover", "i17_distinct_arguments", "i21_merged_clauses", "i28_run_diff",
    "f15_log_metrics", "d18_session_issues", "u1_new_patterns", "w19_stack_slices",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # start executors before timing
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
