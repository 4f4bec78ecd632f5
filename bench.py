"""Benchmark: headline gridcube queries at one scale factor.

Runs each query to completion with the ``noop`` sink (the whole plan runs,
nothing is collected) and prints one JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridcube.plans.queries import QUERIES  # noqa: E402
from gridcube.session import get_spark  # noqa: E402

HEADLINE = [
    "standardize",        # flagship: rename -> standardize -> monthly totals
    "convert_units",
    "monthly_total",
    "add_target_daily",
    "isel",
    "sel",
    "densify",
    "align_positional",
    "max_diff",
    "compare_cubes",
    "cube_shape",
    "parse_paths",
    "dedupe_paths",
    "assign_file_dims",
    "pair_lines",
    "unit_table",
    "read_cube",
    "ingest_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(f"local[{cpus}]", int(cpus) * 2, app_name="gridcube-bench")
    # warm-up: JVM classes, parquet footers
    QUERIES["cube_shape"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "gridcube_headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))


if __name__ == "__main__":
    main()
