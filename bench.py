"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS], the median of three runs after a first one; prints one JSON line.

`cold` has the first runs. What takes more than LONG seconds in its first run is timed by that run alone.
"""

import json
import os
import statistics
import time

from roadlake.plans import QUERIES
from roadlake.session import session

HEADLINE = [
    "trend_hourly", "top_corridors", "composition", "vehicle_ranking", "latest_summary", "history_page", "scope_csv_and_live", "segment_history", "window_mean_emission", "late_events",
    "asof_mapping", "segment_aggregate", "tier2_emission", "display_facts_nn", "nearest_lateral", "trend_range", "flow_exits", "replay_profile", "quintile_class", "bus_stop_scores", "poi_within_500m", "primary_hex", "keyword_score", "bulk_dedup", "bulk_top",
    "segment_map", "live_grid", "hex_context", "grid_static", "grid_hour", "stops_near_lines", "line_cells", "polygon_envelope", "segment_evidence", "road_overview", "snapshot_emissions", "active_mappings", "hexagon_cells",
]

LONG = 8.0


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["composition"](spark, sf).collect()  # starts the engine
    times, cold = {}, {}
    for q in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            QUERIES[q](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
            if runs[0] > LONG:
                break
        cold[q] = round(runs[0], 3)
        times[q] = round(statistics.median(runs[1:] or runs), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf, "cold": cold}))
    spark.stop()


if __name__ == "__main__":
    main()
