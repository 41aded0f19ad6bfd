"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR   folder of parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_RUNS     timed runs per query after one warm-up; the median counts (default 3)

The total is that of the headline queries; the other retail queries are timed once each
after a warm-up and listed apart.

A run builds the query and writes all its rows to Spark's ``noop`` sink, so jobs that
a query starts while it is built are part of its time.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from tillroll.plans.catalog import queries
from tillroll.session import local_session

HEADLINE = [
    "customer_order_summary",
    "monthly_sales_summary",
    "cohort_retention",
    "cohort_retention_pivot",
    "cohort_matrix_dashboard",
    "rfm_scores",
    "rfm_segment_summary",
    "rfm_dashboard",
    "rfm_five_segments",
    "running_spend",
    "repurchase_funnel",
    "interpurchase_by_transition",
    "market_basket_pairs",
    "top_pairs_dashboard",
    "executive_kpis",
    "repeat_customer_rate",
    "monthly_trend",
    "category_performance",
    "channel_distribution",
    "h1_discount_effect",
    "h2_chi_square",
    "h3_first_basket_ltv",
    "analytics_master",
    "order_rollup",
    "lod_customer_fields",
    "dashboard_payload",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session("bench")
    catalogue = queries()

    def timed(name: str, runs: int) -> float:
        times = []
        for _ in range(1 + runs):
            start = time.perf_counter()
            df = catalogue[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        return round(statistics.median(times[1:]), 3)

    seconds = {name: timed(name, runs) for name in sys.argv[1:] or HEADLINE}
    others = {} if sys.argv[1:] else {name: timed(name, 1) for name in catalogue if name not in HEADLINE}
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    result = {
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "others": others,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
