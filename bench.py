"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data, BENCH_CPUS the local cores, BENCH_QUERIES (comma separated)
picks other queries of the catalogue. Every query runs to its last row into a sink that
discards rows. A query runs twice and the second run counts, as on a warm JVM.
"""

from __future__ import annotations

import json
import os
import time

from mound.plans.catalog import QUERIES
from mound.plans.session import build_session

HEADLINE = [
    "w2_asof_pitcher_success_rate",
    "w9_asof_pitcher_prev5_game_success_rate",
    "w14_asof_batter_success_rate",
    "w1_w19_asof_features",
    "w21_pitch_of_pa",
    "w22_rolling",
    "w24_game_seq",
    "j3_join_history_lagged",
    "j5_asof_join",
    "j8_join_context",
    "a1_pitcher_rates",
    "a5_pitcher_profile",
    "a7_arsenal",
    "a8_rate_hierarchy",
    "a9_monthly_rates",
    "a12_target_encode",
    "q5_domains",
    "q8_asof",
    "q9_validate_submission",
    "m4_m5_fit_score",
    "m4_m5_optimum",
    "m7_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(f"local[{cpus}]", max(cpus, 8), "12g")
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    times = {}
    for name in names:
        run(name)
        times[name] = run(name)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
