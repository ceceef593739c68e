"""Voxel and edge costs: exp(lambda (1 - v/max)^2), and their fixed-point forms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAMBDA, MAX_VALUE = 10.0, 255.0


def voxel_cost(v: Column, most: float = MAX_VALUE, lam: float = LAMBDA) -> Column:
    """exp(lambda * (1 - v / most)^2), as a double."""
    return F.exp(lam * (1 - v / most) * (1 - v / most))


def mean_edge_cost(dist: Column, a: Column, b: Column) -> Column:
    """dist * (cost(a) + cost(b)) / 2, as a double."""
    return dist * (voxel_cost(a) + voxel_cost(b)) / 2


def cost_table() -> list[int]:
    """round(1000 * cost) by intensity 0..255."""
    return [round(1000 * math.exp(LAMBDA * (1 - v / MAX_VALUE) ** 2)) for v in range(256)]


def fixed_cost(v: Column) -> Column:
    """round(1000 * cost(v)) from a constant array: exact in any engine."""
    return F.get(F.array(*(F.lit(x).cast("long") for x in cost_table())), v.cast("int"))


def cost_rows(spark: SparkSession) -> DataFrame:
    """(v, gi): the table as rows."""
    return spark.createDataFrame(list(enumerate(cost_table())), "v int, gi long")
