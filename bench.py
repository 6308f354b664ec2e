"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR is the folder of the Parquet tables, BENCH_CPUS the number of local cores. Every query runs
once to warm up and then twice into the noop sink; the median counts.
"""

from __future__ import annotations

import json
import os
import pathlib
import re
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from fundlake import registry  # noqa: E402

QUERIES = [
    "portfolio_performance_ts", "annualized_return_expanding", "portfolio_returns", "portfolio_statement",
    "account_statement", "lot_performance", "key_figures", "fund_price_development",
    "account_balance_history", "load_fund_price_dedup", "html_table_extract",
]
RUNS = 2


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fundlake-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for key in QUERIES:
        runs = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            registry.queries()[key](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[key] = round(statistics.median(runs[1:]), 3)
    spark.stop()
    scale = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({
        "metric": "total_median_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(scale.group(1)) if scale else folder,
    }))


if __name__ == "__main__":
    main()
