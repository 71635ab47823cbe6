"""Time the headline queries; print one JSON line.

Every query runs ``BENCH_RUNS`` times (3); the median counts and the spread is
printed next to it, since single runs differ by a factor of two.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from posigauge.catalog import QUERIES  # noqa: E402
from posigauge.session import local_session  # noqa: E402

HEADLINE = [
    "positivity_overall",
    "positivity_by_age",
    "positivity_by_region",
    "period_correlation",
    "agreement",
    "interval_self_join_semi",
    "dashboard_tests",
    "unique_cases",
    "trailing_week_distinct",
    "daily_counts",
    "clean_tests",
    "episode_ids",
    "glm_logit",
    "hospital_panel",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = local_session(cpus, "posigauge-bench")
    QUERIES["daily_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM side
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    seconds, spread = {}, {}
    for name in names:
        took = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took), 3)
        spread[name] = [round(min(took), 3), round(max(took), 3)]
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "spread": spread,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
