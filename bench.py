"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from workbench.cases import CASES  # noqa: E402
from workbench.compare import session  # noqa: E402

HEADLINE = [
    "passenger_agg",
    "bag_timing",
    "ssr_categories",
    "weather_enrich",
    "slot_congestion",
    "trailing_volatility",
    "flight_features",
    "difficulty_class",
    "daily_rank_spread",
    "destination_baseline",
    "rescore_two_pass",
    "destination_consistency",
    "driver_lifts",
    "eda_summary",
    "ols_delay",
    "feature_corr_matrix",
    "candidate_weight_search",
    "score_auc",
    "tuned_weights",
]


def run(spark, folder: str, name: str) -> float:
    started = time.perf_counter()
    CASES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = session(cores, int(cores) if cores.isdigit() else 8)
    run(spark, folder, "daily_rank")  # the first query pays for starting the engine
    seconds = {name: round(run(spark, folder, name), 3) for name in HEADLINE}
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    result = {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": scale}
    print(json.dumps(result), flush=True)


if __name__ == "__main__":
    main()
