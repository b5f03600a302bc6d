"""Checks of image tables: one row per pixel, keyed by image_id, y and x, linear float channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ShapeError

KEYS = ("image_id", "y", "x")


def require_channels(df: DataFrame, *channels: str, keys: bool = True) -> DataFrame:
    """``df`` if it has the keys and these channels as FLOAT; a ShapeError at plan time if not."""
    for c in KEYS if keys else ():
        if c not in df.columns:
            raise ShapeError(f"no key column {c} in {df.columns}")
    for c in channels:
        if c not in df.columns:
            raise ShapeError(f"no channel {c} in {df.columns}")
        if df.schema[c].dataType != T.FloatType():
            raise ShapeError(f"channel {c} is {df.schema[c].dataType.simpleString()}, not float")
    return df


def as_linear_f32(df: DataFrame, *channels: str) -> DataFrame:
    """``df`` with these channels cast to FLOAT, for numbers of other types."""
    return df.withColumns({c: F.col(c).cast("float") for c in channels})


def grid_faults(df: DataFrame) -> DataFrame:
    """Images that are no dense grid: a cell is missing, doubled, or outside 0..H-1 and 0..W-1. Empty if all are sound."""
    per = df.groupBy("image_id").agg(
        F.count("*").alias("pixels"),
        F.count_distinct("y", "x").alias("cells"),
        F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"),
    )
    area = (F.col("y1").cast("long") + 1) * (F.col("x1").cast("long") + 1)
    return per.where((F.col("pixels") != area) | (F.col("cells") != area) | (F.col("y0") != 0) | (F.col("x0") != 0))


def completed(df: DataFrame) -> DataFrame:
    """Sparse images with a row for each cell from 0, 0 to the last row and column that hold a pixel; new ones are NULL in all but the keys."""
    size = df.groupBy("image_id").agg(F.max("y").alias("_y"), F.max("x").alias("_x"))
    lines = size.select("image_id", F.explode(F.sequence(F.lit(0), "_y")).alias("y"), "_x")
    cells = lines.select("image_id", "y", F.explode(F.sequence(F.lit(0), "_x")).alias("x"))
    return cells.join(df, list(KEYS), "left").select(*df.columns)
