"""Times the headline queries: one warm-up, then the median of three runs.

Prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores;
BENCH_RUNS changes the number of timed runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tickloom.plans.catalog import QUERIES
from tickloom.session import local_session

HEADLINE = [
    "t01_band_position",
    "t15_rates_of_change",
    "t19_volatility",
    "technical_all",
    "w03_rolling_statistics",
    "w04_rolling_quantiles",
    "w07_weighted_means",
    "w15_one_long_series",
    "j01_news_to_bar",
    "j04_asof_backward",
    "g01_news_per_bar",
    "n01_rolling_statistics",
    "calendar_all",
    "x07_daily_context_on_bars",
    "p07_robust_scaling",
    "p10_feature_importance",
    "p05_label_codes",
    "p11_cleaned_table",
    "p14_training_features",
    "d10_residual_bands",
    "p12_sequences",
    "d01_direction_classes",
    "d09_drift",
    "g13_direction_backtest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:] or taken), 3)
        print(f"{name}: first {taken[0]:.2f}, then {times[name]:.2f}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
