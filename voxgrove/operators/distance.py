"""Grey-weighted distance and radius of foreground voxels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.fixpoint import relax
from ..plans.scratch import written
from .stencil import OFFSETS6, OFFSETS26, ball, neighbours, step_length


def border(fg: DataFrame) -> DataFrame:
    """(image_id, idx) of foreground voxels that lack one of six neighbours; beyond the volume is
    background."""
    n = neighbours(fg, OFFSETS6).groupBy("image_id", F.col("src").alias("idx")).agg(F.count("*").alias("n"))
    return fg.select("image_id", "idx").join(n, ["image_id", "idx"], "left").where(F.coalesce("n", F.lit(0)) < 6).select("image_id", "idx")


def grey_weighted(fg: DataFrame) -> DataFrame:
    """(image_id, idx, gwdt): least sum of step times value of the voxel stepped on, from the border."""
    e = neighbours(fg, OFFSETS26).select("image_id", "src", "dst", (step_length(F.col("d2")) * F.col("b")).alias("w"), "ts", "td")
    return relax(written(e, "gwdt-edges"), _zero(border(fg)), "gwdt").select("image_id", "idx", F.col("dist").alias("gwdt"))


def radius_by_steps(fg: DataFrame) -> DataFrame:
    """(image_id, idx, radius): 26-neighbour steps from the border."""
    e = neighbours(fg, OFFSETS26).select("image_id", "src", "dst", F.lit(1).cast("long").alias("w"), "ts", "td")
    return relax(written(e, "radius-edges"), _zero(border(fg)), "radius").select("image_id", "idx", F.col("dist").cast("int").alias("radius"))


def _zero(nodes: DataFrame) -> DataFrame:
    return nodes.select("image_id", "idx", F.lit(0).cast("long").alias("dist"), F.lit(0).cast("long").alias("label"))


def radius_by_ball(fg: DataFrame, first: int = 3) -> DataFrame:
    """(image_id, idx, radius): the largest r such that no ball up to it has more than a thousandth
    of background, places beyond the volume included. Radii up to ``first`` are counted in one round;
    each round after that adds the next shell, for the voxels that passed so far only."""
    ring = F.ceil(F.sqrt(F.col("d2").cast("double"))).cast("int")
    counts = neighbours(fg, ball(first)).groupBy("image_id", F.col("src").alias("idx")).agg(*(F.sum((ring <= r).cast("int")).alias(f"n{r}") for r in range(1, first + 1)))
    rows = fg.select("image_id", "idx").join(counts, ["image_id", "idx"], "left")
    out = F.lit(first)
    for r in range(first, 0, -1):
        out = F.when(_hollow(F.coalesce(f"n{r}", F.lit(0)), len(ball(r))), r - 1).otherwise(out)
    done = written(rows.select("image_id", "idx", out.cast("int").alias("radius"), F.col(f"n{first}").cast("long").alias("n")), "radius-ball")
    parts, passed, r = [done.where(F.col("radius") < first)], done.where(F.col("radius") == first), first
    while passed.head(1):
        r += 1
        shell = _shell(fg.sparkSession, r)
        at = passed.join(fg.select("image_id", "idx", "x", "y", "z", "width", "height", "depth"), ["image_id", "idx"])
        nx, ny, nz = F.col("x") + F.col("dx"), F.col("y") + F.col("dy"), F.col("z") + F.col("dz")
        inside = nx.between(0, F.col("width") - 1) & ny.between(0, F.col("height") - 1) & nz.between(0, F.col("depth") - 1)
        to = (nz.cast("long") * F.col("height") + ny) * F.col("width") + nx
        there = at.crossJoin(F.broadcast(shell)).where(inside).select("image_id", "idx", to.alias("to"))
        more = there.join(fg.select("image_id", F.col("idx").alias("to")), ["image_id", "to"]).groupBy("image_id", "idx").agg(F.count("*").alias("more"))
        n = F.col("n") + F.coalesce("more", F.lit(0))
        places = len(ball(r))
        step = passed.join(more, ["image_id", "idx"], "left").select("image_id", "idx", F.when(_hollow(n, places), r - 1).otherwise(r).cast("int").alias("radius"), n.alias("n"))
        step = written(step, "radius-ball")
        parts.append(step.where(F.col("radius") < r))
        passed = step.where(F.col("radius") == r)
    return reduce(DataFrame.unionByName, parts).select("image_id", "idx", "radius")


def _hollow(n: Column, places: int) -> Column:
    return 1000 * (places - n) > places + 1


def _shell(spark: SparkSession, r: int) -> DataFrame:
    """(dx, dy, dz) of a ball of radius r that one of r - 1 lacks."""
    axis = lambda c: spark.range(-r, r + 1).select(F.col("id").cast("int").alias(c))
    d2 = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")
    return axis("dx").crossJoin(axis("dy")).crossJoin(axis("dz")).where((d2 <= r * r) & (d2 > (r - 1) * (r - 1)))
