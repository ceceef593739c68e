"""SWC skeletons: seven fields a line, parent -1 at a root."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_swc(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, id, type, x, y, z, r, parent) of one file or a folder. Lines that start with #
    are skipped, any white space separates, types may be negative, no order is assumed."""
    names = [("id", "int"), ("type", "int"), ("x", "double"), ("y", "double"), ("z", "double"), ("r", "double"), ("parent", "int")]
    rows = spark.read.text(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("image_id"), F.trim("value").alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    f = F.split("line", r"\s+")
    return rows.select("image_id", *(f[i].cast(kind).alias(n) for i, (n, kind) in enumerate(names)))


def swc_lines(swc: DataFrame) -> DataFrame:
    """(image_id, id, line): the text of each row, seven fields and single spaces."""
    return swc.select("image_id", "id", F.concat_ws(" ", *(F.col(c).cast("string") for c in ("id", "type", "x", "y", "z", "r")), F.coalesce("parent", F.lit(-1)).cast("string")).alias("line"))


def write_swc(swc: DataFrame, path: str) -> None:
    """One text file for each image, <image>_trace.swc in the folder ``path``, lines in order of id. A
    skeleton is far smaller than its volume: one task writes one. The files of earlier runs that
    are written again are replaced."""
    spark = swc.sparkSession
    parts = f"{path.rstrip('/')}/_parts"
    rows = swc_lines(swc).withColumnRenamed("image_id", "image")
    rows.repartition("image").sortWithinPartitions("image", "id").select("image", "line").write.mode("overwrite").partitionBy("image").text(parts)
    # only names are moved: Spark has put each image's lines in one part of a folder of its own
    hadoop = spark._jvm.org.apache.hadoop.fs
    store = hadoop.Path(parts).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in store.listStatus(hadoop.Path(parts)):
        if folder.isDirectory():
            name = unquote(folder.getPath().getName().split("=", 1)[1])
            (part,) = (f for f in store.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-"))
            to = hadoop.Path(f"{path}/{name}_trace.swc")
            store.delete(to, False)
            store.rename(part.getPath(), to)
    store.delete(hadoop.Path(parts), True)
