"""Benchmark the headline queries on the benchmark tables.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set). Each query runs to
completion through the ``noop`` sink (full execution, nothing collected to the
driver). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from revsift.plans.catalog import QUERIES  # noqa: E402
from revsift.session import build_session  # noqa: E402

HEADLINE = [
    "screening_metrics_by_lang",
    "threshold_sweep",
    "positional_pairing",
    "json_flatten",
    "score_batch",
    "token_running",
    "clean_values",
    "extraction_metrics",
    "field_accuracy",
    "match_cascade",
    "unmatched_padding",
    "drop_sections",
    "keep_sections",
    "stream_confusion",
    "csv_candidates",
    "extraction_counts",
    "render_prompt",
    "json_records",
    "score_resume",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2), app_name="revsift-bench")
    # warm-up, untimed: JVM class loading / first code generation, and the Python
    # worker start-up that every Arrow UDF stage otherwise pays on first use
    QUERIES["confusion_counts"](spark, sf_dir).collect()
    QUERIES["normalize_list"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
