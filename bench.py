"""Time the headline queries and print one JSON line. BENCH_SF_DIR and BENCH_CPUS set the data and the cores."""

from __future__ import annotations

import json
import os
import sys
import time

from zephyra.session import local_session
from zephyra.workload.queries import QUERIES

HEADLINE = [
    "build_gold", "clean_silver", "rejection_counts", "quality_flags", "quality_score", "column_profile", "lag_rows",
    "rolling_rows", "rolling_range", "asof_lags", "trailing_stats", "event_features", "fill_missing",
    "feature_statistics", "correlation_matrix", "outliers_iqr", "group_consistency", "scaler_transform",
    "expanding_folds", "leakage_check", "regression_metrics", "error_statistics", "rule_alerts", "suppress_repeats",
    "alert_flow", "alert_stats", "latest_by_city", "event_metrics", "stream_features", "stream_suppress_repeats",
]


def timed(name: str, spark, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session(cores, int(cores))
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        timed(name, spark, folder)  # compile and warm up
        seconds[name] = round(min(timed(name, spark, folder) for _ in range(2)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    scale = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(scale)}))


if __name__ == "__main__":
    main()
