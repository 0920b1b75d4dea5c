"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the cores.
Each query runs once to warm up and then BENCH_RUNS times (default 2); the best run
counts, from building the plan to the last row written to the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import time

from loglantern.plans import all_queries
from loglantern.session import local_session

HEADLINE = (
    "log_lines",
    "line_kinds",
    "entries",
    "stage_counts",
    "log_summary",
    "verdict",
    "top_entries",
    "legacy_rollup",
    "legacy_report",
    "markdown_report",
    "category_freq",
    "crosstab",
    "stratified_split",
    "normalise_text",
    "structural_features",
    "tfidf",
    "model_compare",
    "neighbours",
    "summary_prompt",
    "fix_prompt",
    "fallback_summary",
    "enriched_logs",
    "answer_explanation",
    "chunks",
    "memo_lookup",
    "memo_stats",
)


def timed(build, spark, folder) -> float:
    start = time.perf_counter()
    build(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus, "bench")
    known = all_queries()
    seconds = {}
    for name in HEADLINE:
        timed(known[name], spark, folder)
        seconds[name] = round(min(timed(known[name], spark, folder) for _ in range(runs)), 3)

    events = spark.read.parquet(f"{folder}/events.parquet")
    lines, logs = events.count(), events.select("user_id").distinct().count()
    parse = seconds["log_summary"]
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": cpus,
                "full_parse": {
                    "logs": logs,
                    "lines": lines,
                    "logs_per_sec": round(logs / parse, 1),
                    "lines_per_sec": round(lines / parse, 1),
                },
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
