"""Timings of the headline queries, as one JSON line.

BENCH_SF_DIR  folder of tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)

Each query is run once to warm up, then three times; the median is reported.
Results are written to the ``noop`` sink, so every row is computed in full.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from grainwise.queries import load  # noqa: E402
from grainwise.queries.base import Tables  # noqa: E402
from grainwise.session import configure  # noqa: E402

HEADLINE = [
    "profile_types", "profile_columns", "quality_duplicate_rows", "quality_iqr_outliers", "quality_issues",
    "clean_dedupe", "clean_receipt", "metric_amount", "metric_ratio", "metric_native",
    "group_count", "group_sum", "group_ratio", "ratio_conflicts", "trend_week", "trend_month", "top_n",
    "relationship_profile", "join_left", "join_inner", "join_reconcile", "join_enrichment", "join_lineage",
    "retail_kpis", "retail_monthly", "retail_category_rank", "retail_delivery_review",
    "verify_group", "rate_window", "alert_transitions", "transition_validity", "write_outcomes", "analysis_route",
    "record_checksum",
]
RUNS = 3


def timed(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = configure(
        SparkSession.builder.master(f"local[{cpus}]").appName("grainwise-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    ).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    registry = load()
    wanted = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in wanted:
        def run(q=registry[name]):
            return q.run(Tables(spark, folder))
        timed(run)
        seconds[name] = round(statistics.median(timed(run) for _ in range(RUNS)), 3)
    print(json.dumps({
        "metric": "total of median query seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(folder).name.removeprefix("sf"), "cpus": int(cpus), "runs": RUNS,
    }))


if __name__ == "__main__":
    main()
