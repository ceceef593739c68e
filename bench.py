"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

One query warms up the session; each figure is the least of $BENCH_REPEATS runs (2)."""

import json
import os
import sys
import tempfile
import time


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from voxgrove.operators import distance, stencil, tracing, voxels
    from voxgrove.plans.scratch import written
    from voxgrove.plans.trace import trace
    from voxgrove.sources.volume import proxy_volume

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="voxgrove-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # the small proxy grid is full at this size: a wider one leaves room to grow
    fg = lambda t: voxels.global_threshold(proxy_volume(spark, sf, 256), t)
    kept = lambda df, name: written(df, f"bench-{name}")
    bright = kept(fg(235), "foreground")
    edges = kept(stencil.edges26(bright).select("image_id", "src", "dst", "w", "ts", "td"), "edges")
    seeds = kept(tracing.poisson_seeds(bright), "seeds")
    labels = kept(tracing.fast_marching(edges, seeds), "labels")
    candidates = kept(tracing.merge_candidates(edges, labels), "candidates")
    runs = {
        "slice_profile": lambda: voxels.slice_profile(fg(200)),
        "auto_threshold": lambda: voxels.auto_threshold(proxy_volume(spark, sf, 256)),
        "local_threshold": lambda: stencil.local_threshold(fg(200)),
        "compact_index": lambda: voxels.compact_index(fg(200)),
        "edge_cost": lambda: stencil.edges26(fg(200)),
        "radius_direct": lambda: distance.radius_by_ball(fg(200)),
        "gwdt": lambda: distance.grey_weighted(fg(200)),
        "poisson_seeds": lambda: tracing.poisson_seeds(fg(200)),
        "components": lambda: tracing.voxel_components(stencil.edges26(bright), bright),
        "fast_marching": lambda: tracing.fast_marching(edges, seeds),
        "spanning_forest": lambda: tracing.spanning_forest(candidates),
    }
    took = {}
    for name, f in runs.items():
        for _ in range(int(os.environ.get("BENCH_REPEATS", "2"))):
            began = time.perf_counter()
            f().agg(F.count("*")).collect()
            took[name] = min(round(time.perf_counter() - began, 3), took.get(name, 1e9))
    began = time.perf_counter()
    trace(bright, threshold=235).count()
    took["trace"] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    main()
