"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3).
Each query runs once to warm up, then its time is the median of the runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from classmeter.plans.catalog import QUERIES
from classmeter.session import spark_session

HEADLINE = (
    "top_students",
    "best_score_per_problem",
    "first_attempt_failures",
    "student_performance",
    "problem_statistics",
    "mentor_activity",
    "recent_attempts",
    "recommend_problems",
    "latest_score",
    "my_problems",
    "review_attempts",
    "inbox",
    "score_submissions",
    "orphan_check",
    "append_attempts",
    "apply_feedback",
    "cascade_delete_user",
    "high_score_alerts",
)


def seconds(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = spark_session(
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for key in HEADLINE:
        seconds(QUERIES[key], spark, sf_dir)
        taken = [seconds(QUERIES[key], spark, sf_dir) for _ in range(runs)]
        times[key] = round(statistics.median(taken), 3)
    result = {
        "metric": "total seconds of headline queries (median of warm runs)",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
