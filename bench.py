"""Benchmark of the headline queries.

Runs each query once to warm up, then ``BENCH_RUNS`` (default 5) times, each
time writing the full result to Spark's ``noop`` sink, and reports the median
per query.  Prints ONE JSON line:

  {"metric": "sum_of_median_query_sec", "value": N, "unit": "sec",
   "queries": {"q": sec, ...}, "sf": ..., "value_all": N}

``value`` sums the headline queries (the same as in earlier rounds); the heavier
queries of ``HEAVY`` are measured too and enter ``value_all`` only.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8), BENCH_RUNS (default 5), BENCH_QUERIES (comma list, optional),
BENCH_VIEWS (``derived``, the default: CRM views re-derived from the driver
tables in every query; ``stored``: the views are first written once with
``Tables.materialize`` under the checkpoint folder, untimed, and the
queries read those tables, as a deployment that stores its CRM tables would).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "staff_performance", "dashboard_kpis", "dashboard_staff_kpis", "monthly_bookings",
    "category_stats", "customer_history_top5", "booking_balances", "lead_search",
    "lead_list_page", "lead_360_counts", "followup_list", "export_leads", "apply_bookings",
    "apply_lead_updates", "assign_lead_codes", "booked_status_mismatch",
]
HEAVY = ["lead_360", "assignment_chain_breaks", "apply_hard_delete_counts", "activity_tumbling_counts",
         "stream_conversations"]
STREAMS = {"activity_tumbling_counts", "stream_conversations"}   # they read the driver tables themselves


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    names = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE + HEAVY

    from wayline.plans.registry import REGISTRY, queries
    from wayline.session import build_session, scratch_path
    from wayline.sources.views import Tables

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus)
    qs = queries()
    if os.environ.get("BENCH_VIEWS", "derived") == "stored":
        stored = Tables.of(spark, sf_dir).materialize(scratch_path(spark, "crm-tables"))
        qs = {n: (lambda s, d, _f=REGISTRY[n].fn: _f(stored)) for n in names if n not in STREAMS}
        names = list(qs)
    result: dict[str, float] = {}
    for name in names:
        fn = qs[name]
        times = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:  # first run is the warm-up
                times.append(time.perf_counter() - t0)
        result[name] = round(statistics.median(times), 4)
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    sf = float(m.group(1)) if m else sf_dir
    headline = sum(v for k, v in result.items() if k not in HEAVY)
    print(json.dumps({"metric": "sum_of_median_query_sec", "value": round(headline, 4), "unit": "sec",
                      "queries": result, "sf": sf, "value_all": round(sum(result.values()), 4)}))
    spark.stop()


if __name__ == "__main__":
    main()
