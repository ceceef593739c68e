"""Neighbourhoods as equi-joins: constant offsets, bounds before linearising, then idx = idx."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.costs import fixed_cost

# Offsets and step lengths in thousandths
OFFSETS6 = [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)]
STEPS = {1: 1000, 2: 1414, 3: 1732}
OFFSETS26 = [o for o in product((-1, 0, 1), repeat=3) if any(o)]


def ball(radius: int) -> list[tuple[int, int, int]]:
    """Offsets within a Euclidean radius, without the centre."""
    span = range(-radius, radius + 1)
    return [o for o in product(span, repeat=3) if 0 < sum(c * c for c in o) <= radius * radius]


def cube(radius: int) -> list[tuple[int, int, int]]:
    return [o for o in product(range(-radius, radius + 1), repeat=3) if any(o)]


#: Side of the cubes that loops settle in one task.
SIDE = 32


def tile_of(x: Column, y: Column, z: Column, side: int = SIDE) -> Column:
    """The number of a voxel's cube in its image."""
    cut = lambda c: F.floor(c / side)
    return (cut(z) * (cut(F.col("height") - 1) + 1) + cut(y)) * (cut(F.col("width") - 1) + 1) + cut(x)


def reach(voxels: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """(image_id, src, v, dir, d2, dst, ts, td): each voxel's places in bounds, and the tiles of both. The
    offsets are constants of the plan: no join, no shuffle."""
    rows = F.array(*(F.struct(F.lit(i).alias("dir"), F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(c).alias("dz"), F.lit(a * a + b * b + c * c).alias("d2")) for i, (a, b, c) in enumerate(offsets)))
    o = voxels.select("image_id", "idx", "x", "y", "z", "v", "width", "height", "depth", F.explode(rows).alias("o"))
    nx, ny, nz = F.col("x") + F.col("o.dx"), F.col("y") + F.col("o.dy"), F.col("z") + F.col("o.dz")
    inside = nx.between(0, F.col("width") - 1) & ny.between(0, F.col("height") - 1) & nz.between(0, F.col("depth") - 1)
    to = (nz.cast("long") * F.col("height") + ny) * F.col("width") + nx
    return o.where(inside).select("image_id", F.col("idx").alias("src"), "v", "o.dir", "o.d2", to.alias("dst"), tile_of(F.col("x"), F.col("y"), F.col("z")).alias("ts"), tile_of(nx, ny, nz).alias("td"))


def neighbours(voxels: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """(image_id, src, dst, dir, d2, a, b, ts, td): pairs of stored voxels, with both values and tiles."""
    there = voxels.select("image_id", F.col("idx").alias("dst"), F.col("v").alias("b"))
    return reach(voxels, offsets).join(there, ["image_id", "dst"]).select("image_id", "src", "dst", "dir", "d2", F.col("v").alias("a"), "b", "ts", "td")


def step_length(d2: Column) -> Column:
    return F.when(d2 == 1, 1000).when(d2 == 2, 1414).otherwise(1732).cast("long")


def edges26(voxels: DataFrame) -> DataFrame:
    """(image_id, src, dst, dir, step, a, b, w, ts, td): 26-neighbours with w = step (cost(a) + cost(b))."""
    e = neighbours(voxels, OFFSETS26).withColumn("step", step_length(F.col("d2")))
    return e.select("image_id", "src", "dst", "dir", "step", "a", "b", (F.col("step") * (fixed_cost(F.col("a")) + fixed_cost(F.col("b")))).alias("w"), "ts", "td")


def local_threshold(voxels: DataFrame, radius: int = 2) -> DataFrame:
    """Voxels in the top twentieth of their neighbourhood, themselves counted:
    20 * (neighbours with a greater value) < neighbours."""
    n = neighbours(voxels, cube(radius)).groupBy("image_id", F.col("src").alias("idx")).agg(F.count("*").alias("_n"), F.sum((F.col("b") > F.col("a")).cast("long")).alias("_more"))
    rows = voxels.join(n, ["image_id", "idx"], "left")
    return rows.where(20 * F.coalesce("_more", F.lit(0)) < F.coalesce("_n", F.lit(0)) + 1).drop("_n", "_more")


def encode_parents(forest: DataFrame, voxels: DataFrame) -> DataFrame:
    """(image_id, idx, x, y, z, width, height, dir): the number of the 26-neighbour offset to the parent;
    null at a root."""
    at = voxels.select("image_id", "idx", "x", "y", "z", "width", "height")
    up = at.select("image_id", F.col("idx").alias("parent_idx"), *(F.col(c).alias(f"p{c}") for c in "xyz"))
    n = sum(((F.col(f"p{c}") - F.col(c) + 1) * k for c, k in (("x", 9), ("y", 3), ("z", 1))), F.lit(0))
    rows = forest.select("image_id", "idx", "parent_idx").join(at, ["image_id", "idx"]).join(up, ["image_id", "parent_idx"], "left")
    return rows.select("image_id", "idx", "x", "y", "z", "width", "height", (n - F.when(n > 13, 1).otherwise(0)).cast("int").alias("dir"))


def decode_parents(rows: DataFrame) -> DataFrame:
    """(image_id, idx, parent_idx) from the number ``dir`` of a 26-neighbour offset; null: a root."""
    part = lambda k: F.get(F.array(*(F.lit(o[k]) for o in OFFSETS26)), F.col("dir"))
    parent = ((F.col("z") + part(2)).cast("long") * F.col("height") + F.col("y") + part(1)) * F.col("width") + F.col("x") + part(0)
    return rows.select("image_id", "idx", F.when(F.col("dir").isNotNull(), parent).alias("parent_idx"))
