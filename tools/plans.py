"""Print the physical plans of headline queries (exprIds stripped).

    python tools/plans.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from linkloom.catalog import QUERIES  # noqa: E402
from linkloom.session import checkpoint_dir, local_session  # noqa: E402

DEFAULT = ["page_rows", "bm25_fit_text", "dedupe_first", "top_results_score", "pages_done", "job_status",
           "fetch_schedule", "nav_records"]


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.1"
    names = [a for a in args if not a.startswith("/")] or DEFAULT
    spark = local_session(8, shuffle_partitions=16)
    checkpoint_dir(spark)
    for name in names:
        df = QUERIES[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()  # final adaptive plan
        plan = df._jdf.queryExecution().executedPlan().toString()
        plan = re.sub(r"#\d+L?", "", plan)
        print(f"### {name}\n```")
        for line in plan.splitlines():
            print(line[:170])
        print("```\n")
    spark.stop()


if __name__ == "__main__":
    main()
