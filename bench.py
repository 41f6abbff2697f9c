"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and is then timed BENCH_REPEATS times (median). Results are written
to the no-op sink, so every row is computed. BENCH_NATIVE=<n> adds sampling of n instants on the
0.25 degree grid (976,896 samples each).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
NATIVE = int(os.environ.get("BENCH_NATIVE", "0"))
HEADLINE = (
    "Q01_detect_extrema", "Q02_cluster_extrema", "Q03_detect_blocking", "Q04_heat_clusters",
    "Q05_contour_map_data", "Q05_isolines_in_area", "Q06_combined_map_data", "Q06_formation_map_data",
    "Q06_surface_map_data", "Q07_request_lifecycle", "A03_connected_components", "A07_ray_reach",
    "A16_group_requests", "F01_request_hash", "J14_map_tasks", "U01_admit_requests", "U02_settle_results",
    "U03_expire_files", "W11_progress_running",
)


def timed(make) -> float:
    t = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def native(spark, n: int):
    from pyspark.sql import functions as F

    from isohypsa.operators.extrema import votes_from_slices
    from isohypsa.params import GridSpec
    from isohypsa.registry.inputs import synth_field
    from isohypsa.sources.grid import to_slices
    from isohypsa.staging import stage

    spec = GridSpec()
    params = spark.range(n).select(F.col("id").cast("int").alias("time"), F.lit(5).cast("bigint").alias("s")).repartition(8, "time", "s")
    slices = stage(to_slices(synth_field(params, spec), spec), "native")
    return lambda: votes_from_slices(slices, spec)


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from isohypsa.registry import load
    from isohypsa.session import local_session

    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session("bench", cpus)
    queries = load()[0]
    seconds: dict[str, float] = {}
    spread: dict[str, float] = {}
    for name in HEADLINE:
        def make(q=queries[name]):
            return q(spark, SF_DIR)
        timed(make)
        runs = [timed(make) for _ in range(REPEATS)]
        seconds[name], spread[name] = round(statistics.median(runs), 3), round(max(runs) - min(runs), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    instants = (events + 999) // 1000
    extra = {"instants": instants, "res": 2.5, "samples_per_sec_q01": round(instants * 340_992 / seconds["Q01_detect_extrema"])}
    if NATIVE:
        make = native(spark, NATIVE)
        timed(make)
        t = statistics.median(timed(make) for _ in range(REPEATS))
        extra["native_sec_per_instant"] = round(t / NATIVE, 4)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total of medians", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "spread": spread, "repeats": REPEATS, "sf": os.path.basename(SF_DIR.rstrip("/")), "cpus": int(cpus), **extra,
    }))


if __name__ == "__main__":
    main()
