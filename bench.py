"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local threads. Every query runs once
to warm up and then BENCH_RUNS times; the fastest run counts. Results are written to Spark's noop
sink, so all rows are computed and none are collected.
"""

from __future__ import annotations

import json
import os
import time

from marketloom.plans.queries import queries
from marketloom.session import build_session

HEADLINE = [
    "q01_orders_with_customer",
    "q02_customer_orders_nested",
    "q03_order_detail",
    "q04_customer_order_summary",
    "q05_customer_order_summary_strict",
    "q06_sales_stats",
    "q07_customers_with_order_count",
    "q08_product_catalogue",
    "q14_favorite_products",
    "q17_review_of_order",
    "q19_payment_of_order",
    "q22_enrich_addresses",
    "m01_set_status",
    "m03_place_orders",
    "m07_fold_order_log",
    "m07_fold_order_log_decisions",
    "m08_add_order_reviews",
    "m14_toggle_favorites",
    "m17_register_customers",
    "c1_duplicate_keys",
    "x1_stream_order_status",
    "x2_stream_favorites",
]


def scale(folder: str) -> float | str:
    name = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    try:
        return float(name)
    except ValueError:
        return name


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = os.environ.get("BENCH_QUERIES")
    spark = build_session(
        "marketloom-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            # Small test data: let a partition of a few kilobytes still have its own thread.
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "32k",
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    seconds = {}
    for name in wanted.split(",") if wanted else HEADLINE:
        best = None
        for _ in range(runs + 1):
            start = time.perf_counter()
            registered[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": scale(folder),
            }
        )
    )


if __name__ == "__main__":
    main()
