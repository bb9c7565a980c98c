"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "speed_realism", "e02_kinematics", "e03_kinematic_validity", "d01_displacement_error", "d02_histogram_loglik", "c05_nearest_object",
    "c06_time_to_collision", "c07_road_edge_distance", "c08_nearest_lane", "c09_offroad_flags", "c12_partner_features", "c13_road_features",
    "c15_lane_successors", "c16_lookahead_goal", "e06_ego_observations", "e13_clipped_advantage", "d07_scenario_scores", "d12_fleet_metrics",
    "d23_within_segment_r2", "d25_reward_attribution", "d35_last_n_summary", "e17_dedupe_reprints", "f02_stratified_split", "f05_pareto_front", "i02_episodes",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("TRAJLAKE_SHUFFLE", cpus if cpus.isdigit() else "8")
    from trajlake.plans.catalog import QUERIES
    from trajlake.session import local_session

    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["e01_central_diff"](spark, sf).write.format("noop").mode("overwrite").save()  # JVM and scan warm-up
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        # The noop sink computes every column of every row without collecting any.
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
