"""Time the headline queries over whole tables; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from tablescope.session import local_session  # noqa: E402

HEADLINE = [
    "kpis", "profile_columns", "issues_all", "clean_full", "correlation_matrix", "monthly_ma3", "distribution_metrics", "box_by_category",
    "treemap_rollup", "pivot_heatmap", "declining_region", "q_top_percentile", "insight_cards", "categorical_insight", "quality_score_issues", "answer_questions",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, 2 * int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    # Start the session and read the file footers once, outside the timings.
    QUERIES["global_totals"](spark, folder).collect()
    seconds = {}
    for name in HEADLINE:
        begun = time.time()
        # The noop sink runs the whole query and keeps no rows.
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - begun, 3)
    print(json.dumps({
        "metric": "headline queries, wall clock", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
