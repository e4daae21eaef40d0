"""Benchmark: headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: Each query runs so often; the median counts.
REPEATS = 3

HEADLINE = [
    "extract_class_counts",   # pages -> items -> dedup -> counts (flagship)
    "p6_extract",             # gates + extraction with rendered fallback
    "h1_links",               # link table
    "f1_f6_url_filters",      # URL predicates
    "p7_dedup_template",      # template detection + dedup
    "c2_c3_chunk_2000",       # chunk fold
    "p8_scrape_items",        # end to end on the archive
    "a7_a9_by_category",      # report over 100k results at sf0.1
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from sitesift.plans.catalog import queries
    from sitesift.session import get_spark

    spark = get_spark(
        f"local[{cpus}]", max(cpus * 2, 8),
        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
               "spark.sitesift.readPartitions": str(2 * cpus),
               "spark.checkpoint.dir": tempfile.mkdtemp(prefix="sitesift-bench-ckpt-")},  # local: one machine
    )
    qs = queries()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in qs]
    times = {}
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not a query's time
    for name in names:
        runs = []
        for _ in range(REPEATS):
            t0 = time.time()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t0)
        times[name] = round(statistics.median(runs), 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_jobs_total_wall", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""), "cpus": cpus}))


if __name__ == "__main__":
    main()
