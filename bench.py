"""Time the headline jobs on one machine and print one JSON line.

BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_RUNS     timed runs per query after one warm-up; the median counts (default 3)
BENCH_QUERIES  comma-separated query names (default: the headline list)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.catalog import load  # noqa: E402
from larder.session import clear_staged, local_session  # noqa: E402

HEADLINE = [
    "report_counts",
    "stock_status",
    "reorder_suggestions",
    "applied_stock",
    "redistributed_stock",
    "audit_mismatches",
    "price_flags",
    "sales_impact",
    "daily_demand",
    "naive_forecast",
    "lags",
    "rolling_means",
    "seasonal_decomposition",
    "chronological_holdout",
    "price_quantiles",
    "demand_features",
    "evaluation",
    "movement_log",
    "intent_counts",
    "trend_forecast",
    "single_boosted_forecast",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE
    spark = local_session(cpus, app="bench", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.showConsoleProgress": "false"})
    catalog = load()
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            catalog[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
            if times[-1] > 60:  # a long query is its own warm-up
                break
        seconds[name] = round(statistics.median(times[1:] or times), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    clear_staged(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
