"""The whole trace: volume to numbered skeleton."""

from __future__ import annotations

import json
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import distance, skeleton, stencil, tracing, voxels
from ..sources.swc import write_swc
from ..sources.volume import read_tiff
from .scratch import written


class Timings(dict):
    """Seconds of each stage, as they were built and written."""

    @contextmanager
    def stage(self, name: str):
        began = time.perf_counter()
        yield
        self[name] = round(time.perf_counter() - began, 3)


def foreground(volume: DataFrame, threshold: int = -1, local: bool = False) -> DataFrame:
    """Voxels that are traced: by a fixed threshold, or -1 for each image's own; ``local`` keeps the
    top twentieth of each neighbourhood only."""
    rows = voxels.compact(volume)
    rows = voxels.auto_threshold(rows) if threshold < 0 else voxels.global_threshold(rows, threshold)
    return stencil.local_threshold(rows) if local else rows


def marched(fg: DataFrame, radius: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, labels, forest) of a foreground."""
    edges = written(stencil.edges26(fg).select("image_id", "src", "dst", "w", "ts", "td"), "edges")
    labels = written(tracing.fast_marching(edges, tracing.poisson_seeds(fg, radius)), "labels")
    return edges, labels, written(tracing.parent_forest(edges, labels), "forest")


def trace(volume: DataFrame, threshold: int = -1, local: bool = False, min_nodes: int = 32, seed_radius: int = 1, reweigh: bool = False, timings: Timings | None = None) -> DataFrame:
    """SWC rows of every image. ``reweigh`` replaces intensities by their grey-weighted distance,
    scaled to 1..255, before the fronts start."""
    t = Timings() if timings is None else timings
    with t.stage("threshold"):
        fg = written(foreground(volume, threshold, local), "foreground")
    if reweigh:
        with t.stage("distance"):
            g = distance.grey_weighted(fg)
            most = g.groupBy("image_id").agg(F.greatest(F.max("gwdt"), F.lit(1)).alias("most"))
            scaled = fg.drop("v").join(g, ["image_id", "idx"], "left").join(most, "image_id")
            fg = written(scaled.withColumn("v", (1 + F.floor(254 * F.coalesce("gwdt", F.lit(0)) / F.col("most"))).cast("int")).select(fg.columns), "reweighed")
    with t.stage("march"):
        edges, labels, forest = marched(fg, seed_radius)
    with t.stage("merge"):
        mst = written(tracing.spanning_forest(tracing.merge_candidates(edges, labels)), "mst")
        segments = written(skeleton.segment_components(labels, mst), "segments")
        tree = skeleton.reroot(forest, mst, segments)
    with t.stage("prune"):
        rows = written(skeleton.prune(skeleton.chains(tree, fg), min_nodes), "chains")
    with t.stage("radius"):
        radii = written(distance.radius_by_ball(fg), "radii")
    with t.stage("refine"):
        rows = written(skeleton.refine(rows, fg, radii), "refined")
    with t.stage("number"):
        return written(skeleton.number(rows, fg, radii), "swc")


def trace_path(spark: SparkSession, path: str, out: str | None = None, threshold: int = -1, local: bool = False, **options) -> DataFrame:
    """Trace a .tif file, or every one in a folder, in one job; write SWC files if ``out`` is given."""
    volume = written(read_tiff(spark, path), "volume")
    swc = trace(volume, threshold, local, **options)
    if out:
        write_swc(swc, out)
    return swc


def main(args: list[str]) -> None:
    """``python -m voxgrove.plans.trace PATH THRESHOLD LOCAL OUT``: threshold -1 is automatic, LOCAL 0
    is off."""
    path, threshold, local, out = args
    spark = SparkSession.builder.appName("voxgrove").getOrCreate()
    timings = Timings()
    trace_path(spark, path, out, int(threshold), local != "0", timings=timings)
    print(json.dumps(timings))


if __name__ == "__main__":
    import sys

    main(sys.argv[1:])
    SparkSession.getActiveSession().stop()
