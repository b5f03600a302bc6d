"""Images made from nothing: each is a range with expressions, made in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lit32

PATCH, COLUMNS, ROWS = 64, 6, 4

# Linear red, green and blue of the 24 chart patches, row by row.
CHART = (
    (0.400, 0.225, 0.155), (0.763, 0.488, 0.349), (0.183, 0.267, 0.467), (0.149, 0.200, 0.086), (0.341, 0.345, 0.625), (0.148, 0.604, 0.531),
    (0.763, 0.325, 0.031), (0.102, 0.145, 0.510), (0.631, 0.165, 0.165), (0.082, 0.045, 0.122), (0.416, 0.620, 0.059), (0.749, 0.514, 0.012),
    (0.027, 0.063, 0.416), (0.090, 0.306, 0.094), (0.502, 0.039, 0.031), (0.714, 0.620, 0.008), (0.565, 0.122, 0.404), (0.012, 0.353, 0.502),
    (0.914, 0.914, 0.914), (0.573, 0.573, 0.573), (0.353, 0.353, 0.353), (0.188, 0.188, 0.188), (0.086, 0.086, 0.086), (0.031, 0.031, 0.031),
)


def _grid(spark: SparkSession, height: int, width: int, image_id: int) -> DataFrame:
    return spark.range(height * width).select(F.lit(image_id).cast("long").alias("image_id"), F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))


def constant_image(spark: SparkSession, height: int, width: int, image_id: int = 0, **channels: float) -> DataFrame:
    """An image whose channels, given by name, are constant."""
    return _grid(spark, height, width, image_id).select("*", *[lit32(v).alias(c) for c, v in channels.items()])


def ramp_image(spark: SparkSession, height: int, width: int, scale: float | None = None, image_id: int = 0) -> DataFrame:
    """Luminance that grows by pixel in row-major order, by 1 / ``scale`` (the number of pixels if not given)."""
    at: Column = F.col("y") * width + F.col("x")
    return _grid(spark, height, width, image_id).select("*", (at / F.lit(float(scale or height * width))).cast("float").alias("l"))


def color_chart(spark: SparkSession, image_id: int = 0) -> DataFrame:
    """The chart of 24 patches in four rows, 64 pixels each."""
    patches = F.broadcast(spark.createDataFrame([(i, *p) for i, p in enumerate(CHART)], "patch int, r float, g float, b float"))  # 24 rows
    grid = _grid(spark, PATCH * ROWS, PATCH * COLUMNS, image_id).withColumn("patch", (F.floor(F.col("y") / PATCH) * COLUMNS + F.floor(F.col("x") / PATCH)).cast("int"))
    return grid.join(patches, "patch").select("image_id", "y", "x", "r", "g", "b")
