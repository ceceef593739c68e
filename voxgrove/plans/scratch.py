"""Cutting lineage in driver loops: tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a plain local master may fall back to a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="voxgrove-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table read back; lost executors reread it."""
    spark = df.sparkSession
    path = f"{folder(spark)}/voxgrove-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table of ``written`` that nothing reads any more."""
    if hasattr(df, "_path"):
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(df._path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
