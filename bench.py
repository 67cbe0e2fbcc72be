"""Times the headline queries and prints one JSON line: python bench.py"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dockflow.catalog import load  # noqa: E402
from dockflow.session import get_spark  # noqa: E402

HEADLINE = [
    "hourly_net_demand", "demand_rollups", "top_routes", "nation_flows", "station_quality", "hourly_grid", "grid_lags", "grid_rolling", "grid_ema",
    "feature_table", "serving_features", "overview_kpis", "overview_series", "overview_anomalies", "station_kpis", "map_data", "route_data",
    "live_stations", "rebalancing_board", "stations_near_points", "hexagons", "nearest_station", "outlier_flags", "dominant_frequencies",
    "denoised_pickups", "time_split", "statistical_forecast", "ensemble_forecast", "forecast_metrics", "sliced_errors", "streamed_hourly_pickups",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = get_spark("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    times = {}
    for name in HEADLINE:
        seen = []
        for _ in range(runs):  # first run warms up, the rest count
            start = time.time()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            seen.append(time.time() - start)
            spark.catalog.clearCache()
        times[name] = round(statistics.median(seen[1:] or seen), 3)
        print(f"{name} {seen}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
