"""Time the queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs to its last row and column. BENCH_QUERIES picks some of them, BENCH_RUNS the
number of runs whose median counts. A few queries on the smallest data warm the JVM first.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from orderloom.plans.registry import QUERIES
from orderloom.session import build_session

WARM_UP = "/root/testdata/sf0.001"
WARMING = (  # together they touch most of the code
    "fact_orders_incremental", "silver_order_details", "dim_products_scd2", "dq_report", "rt_recommendations",
)


def seconds(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", ",".join(QUERIES)).split(",")
    spark = build_session(
        "bench",
        {
            "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
        },
        f"local[{cpus}]",
    )
    spark.sparkContext.setLogLevel("ERROR")
    warm_up = WARM_UP if os.path.isdir(WARM_UP) else folder
    for name in WARMING:
        seconds(spark, name, warm_up)
    times = {}
    for name in names:
        times[name] = round(statistics.median(seconds(spark, name, folder) for _ in range(runs)), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total time of all queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
