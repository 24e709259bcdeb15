"""Time the headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]`` and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from runloom.plans import registry
from runloom.session import local_session

# One query per area; the first five are the measured jobs of the baseline: statistics, grades, export, all together.
HEADLINE = (
    "stats_global", "stats_by_workflow", "classify_runs", "grade_distribution", "performance_report", "details_report",
    "stats_by_dimensions", "validate_runs", "status_from_payload", "normalize_samples", "run_index", "run_statistics",
    "stop_max_failures", "cases_pairwise", "generate_cases", "extract_placeholders", "parse_sections", "render_prompt_state",
    "prompt_blocks", "constraint_coverage", "merge_actions", "normalize_actions", "plateau_detect", "similarity", "stream_collect",
    "rate_limit_admission",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    registry.load()
    spark = local_session(cpus, app="runloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["run_count"](spark, folder).collect()  # start the executors
    seconds = {}
    for name in names:
        start = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    events = spark.read.parquet(f"{folder}/events.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries, each run once after start-up",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cores": cpus,
                "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
                "spark": spark.version,
                "events_rows": events,
                "stats_rows_per_sec": round(events / seconds["stats_by_workflow"]) if "stats_by_workflow" in seconds else None,
                "classify_rows_per_sec": round(events / seconds["classify_runs"]) if "classify_runs" in seconds else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
