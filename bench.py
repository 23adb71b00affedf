"""Headline queries, timed.  Prints one JSON line.

BENCH_SF_DIR   table directory (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spendframe import build_session  # noqa: E402
from workload.queries import REGISTRY  # noqa: E402

HEADLINE = (
    "cost_by_service_daily",
    "cost_by_account_daily",
    "cost_by_tag_daily",
    "cost_by_service_hourly",
    "report_json_grouped",
    "series_length_gate",
    "forecast_table",
    "forecast_table_suppliers",
    "milestone_summary",
    "forecast_hw_daily",
    "forecast_arima",
    "forecast_fourier_trend",
    "forecast_lag_linear",
    "forecast_lag_forest",
    "forecast_sarima",
    "rolling_sma",
    "rolling_es",
    "anomaly_periods",
    "budget_all",
    "spike_pct",
    "random_spikes",
    "gen_noise",
)


def run(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("spendframe-bench", master=f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM's and the Python workers' code once, outside the timings
    run(spark, "cost_total_daily", sf_dir)
    run(spark, "forecast_hw", sf_dir)
    timings = {name: round(run(spark, name, sf_dir), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
