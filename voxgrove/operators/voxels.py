"""Filters, compaction and data-parallel primitives on sparse voxels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import written

BROADCAST_IMAGES = 1_000_000


def global_threshold(voxels: DataFrame, t) -> DataFrame:
    """Foreground: v >= t."""
    return voxels.where(F.col("v") >= t)


def auto_thresholds(voxels: DataFrame) -> DataFrame:
    """(image_id, t): floor(mean + 0.5 max(standard deviation, 10)) over stored voxels, from exact
    sums of whole numbers."""
    s = voxels.groupBy("image_id").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v").cast("long") * F.col("v")).alias("q"))
    spread = F.sqrt((F.col("n") * F.col("q") - F.col("s") * F.col("s")).cast("double")) / F.col("n")
    return s.select("image_id", F.floor(F.col("s") / F.col("n") + 0.5 * F.greatest(spread, F.lit(10.0))).cast("int").alias("t"))


def auto_threshold(voxels: DataFrame) -> DataFrame:
    """Foreground by each image's own threshold. One number for each image is broadcast, up to
    ``BROADCAST_IMAGES`` of them, so that the volume is not shuffled."""
    t = written(auto_thresholds(voxels), "thresholds")
    return voxels.join(F.broadcast(t) if t.count() <= BROADCAST_IMAGES else t, "image_id").where("v >= t").drop("t")


def slice_profile(voxels: DataFrame) -> DataFrame:
    """(image_id, z, n, total): voxels and their sum by slice."""
    return voxels.groupBy("image_id", "z").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


def compact(voxels: DataFrame) -> DataFrame:
    """Stored voxels without zeros."""
    return voxels.where("v > 0")


def compact_index(voxels: DataFrame, tile: int = 1 << 16) -> DataFrame:
    """(image_id, idx, cid): cid numbers voxels from 0 in order of idx. In two passes: counts of
    tiles of the index, their prefix sum, then numbers within each tile, so that no task sorts an image."""
    rows = compact(voxels).select("image_id", "idx", F.floor(F.col("idx") / tile).alias("tile"))
    w = Window.partitionBy("image_id").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("image_id", "tile").count().select("image_id", "tile", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("image_id", "tile").orderBy("idx")) - 1
    return rows.select("*", own.alias("own")).join(base, ["image_id", "tile"]).select("image_id", "idx", (F.col("base") + F.col("own")).alias("cid"))


def compact_lookup(index: DataFrame, cids: DataFrame) -> DataFrame:
    """(image_id, cid, idx) of the given compact numbers."""
    return cids.join(index, ["image_id", "cid"]).select("image_id", "cid", "idx")


def fill(rows: DataFrame, column: str, value) -> DataFrame:
    return rows.withColumn(column, F.lit(value))


def replace_if(rows: DataFrame, column: str, test: Column, value) -> DataFrame:
    return rows.withColumn(column, F.when(test, F.lit(value)).otherwise(F.col(column)))


def prefix_sum(rows: DataFrame, value: Column, by: list[str], order: str, inclusive: bool = True, tile: int = 1 << 16) -> DataFrame:
    """``rows`` with ``scan``: the running sum of an expression in order of a whole-number column,
    in two passes like compact_index."""
    end = 0 if inclusive else -1
    r = rows.withColumn("_value", value).withColumn("_tile", F.floor(F.col(order) / tile))
    before = Window.partitionBy(*by).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    base = r.groupBy(*by, "_tile").agg(F.sum("_value").alias("_s")).select(*by, "_tile", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    own = F.coalesce(F.sum("_value").over(Window.partitionBy(*by, "_tile").orderBy(order).rowsBetween(Window.unboundedPreceding, end)), F.lit(0))
    return r.withColumn("_own", own).join(base, [*by, "_tile"]).withColumn("scan", F.col("_base") + F.col("_own")).drop("_value", "_tile", "_own", "_base")


def reduce_stats(voxels: DataFrame) -> DataFrame:
    """(image_id, n, total, least, most)."""
    return voxels.groupBy("image_id").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.min("v").alias("least"), F.max("v").alias("most"))


def extrema(voxels: DataFrame) -> DataFrame:
    """(image_id, low_idx, high_idx): where the least and largest value are, ties to the lower idx."""
    return voxels.groupBy("image_id").agg(F.min(F.struct("v", "idx"))["idx"].alias("low_idx"), F.min(F.struct(-F.col("v"), "idx"))["idx"].alias("high_idx"))


def copy_if(rows: DataFrame, test: Column) -> DataFrame:
    return rows.where(test)


def remove_if(rows: DataFrame, test: Column) -> DataFrame:
    return rows.where(~F.coalesce(test, F.lit(False)))


def scatter(rows: DataFrame, targets: DataFrame, on: list[str], column: str, value: str) -> DataFrame:
    """``rows`` with ``column`` replaced by ``value`` of the target that names the row."""
    t = targets.select(*on, F.col(value).alias("_new"), F.lit(True).alias("_hit"))
    return rows.join(t, on, "left").withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))).drop("_new", "_hit")


def sequence(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"))
