"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR   table folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names, or `all`
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from tidemark import configure  # noqa: E402
from tidemark.plans import catalog  # noqa: E402

HEADLINE = [
    "fleet_health", "counter_rate", "counter_rate_same_second", "delta", "delta_ratio", "delta_share",
    "changed_rate", "rate_of_sum", "sum_over_labels", "label_counts", "dedup_last", "latest_snapshot",
    "histogram_quantile", "gc_kind", "mean_latency", "with_attribute", "with_identity",
    "exposition_lines", "exposition_histogram", "bean_map", "json_paths", "kv_lines", "csv_rows",
    "influx", "prometheus", "route_outcomes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = configure(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(queries) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    # One unmeasured query warms up the session.
    queries["count_by_category"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        begin = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - begin, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
