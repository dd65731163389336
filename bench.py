"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from odflow.queries import QUERIES  # noqa: E402
from odflow.session import build_session  # noqa: E402

HEADLINES = [
    "hourly_pairs",
    "daily_pairs",
    "combine_colors",
    "route_selection",
    "demand_features",
    "duration_features",
    "congestion_features",
    "feature_table",
    "calendar_features",
    "points_in_zones",
    "stop_zone_map",
    "demand_upsert",
    "lag_correlation",
    "price_quantiles",
    "disruption_flag",
    "walk_forward_folds",
    "seasonal_baseline",
    "horizon_matrix",
    "batch_forecast_lists",
    "quality_report",
    "delay_log_stream",
    "quantile_forest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    parallel = int(cpus) if cpus.isdigit() else os.cpu_count()
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        parallel,
        {"spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")},
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - began, 3)

    run(HEADLINES[0])  # JVM start and class loading are not part of any query
    seconds = {name: run(name) for name in sys.argv[1:] or HEADLINES}
    scale = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale.group(1)) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
