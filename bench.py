"""Headline-query timings.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is run to completion with the no-op sink (every row computed,
nothing collected to the driver) and timed; prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "page_top_focus", "page_rows", "page_links", "bm25_fit_text", "pruned_text", "nav_records", "doc_bm25",
    "crawl_bfs", "crawl_dfs", "crawl_bestfirst", "crawl_budget",
    "top_results_score", "dedupe_first", "pages_done", "paginate_results", "progress_lines", "export_md_rows",
    "error_breakdown", "job_defaults", "config_violations", "plans_parsed", "job_status", "fetch_schedule",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from linkloom.catalog import QUERIES
    from linkloom.session import checkpoint_dir, local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="linkloom-bench")
    checkpoint_dir(spark)
    spark.read.parquet(f"{sf_dir}/pages.parquet").count()  # warm the JVM
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
