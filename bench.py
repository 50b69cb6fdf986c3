"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR  table folder (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores (default 8)
    BENCH_RUNS    timed runs per query after one warm-up; the median counts (default 3)
    BENCH_ALL     any value: every registered query instead of the headline ones
"""

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from frameprobe.session import build_session  # noqa: E402
from workload.queries import REGISTRY  # noqa: E402

HEADLINE = [
    "describe_lineitem", "hist_lineitem", "box_lineitem", "kde_lineitem_quantity", "outliers_events",
    "table_profile_events", "missing_counts_orders", "duplicate_rows_lineitem",
    "column_profile_events", "column_profile_documents", "group_columns_lineitem", "overview_orders",
    "category_freq_lineitem", "crosstab_lineitem", "cramers_lineitem", "eta_lineitem",
    "grouped_box_lineitem", "corr_lineitem", "pair_rank_lineitem", "sample_orders",
    "csv_roundtrip_orders", "csv_types_orders", "delimiter_pick", "path_audit_part",
    "report_manifest_lineitem",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = list(REGISTRY) if os.environ.get("BENCH_ALL") else HEADLINE
    spark = build_session("bench", f"local[{cpus}]", int(cpus), spark__ui__showConsoleProgress="false",
                          spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")

    def run(name):
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        run(name)
        times[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
