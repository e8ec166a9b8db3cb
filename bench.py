"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from editlens.plans.catalog import QUERIES
from editlens.session import local_session

HEADLINE = (
    "p05_explode_instructions",
    "k01_error_counts",
    "k04_duration_dtw",
    "a10_span_stats",
    "a07_summarize",
    "j11_diff_contract",
    "a13_request_counts",
    "j13_refresh_alignments",
    "w03_terminal_status",
    "c06_alignment",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": Path(sf).name}))


if __name__ == "__main__":
    main()
