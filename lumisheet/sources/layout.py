"""Pixel tables and scanline tables (a row for each line, a channel as an array)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scanlines_of(df: DataFrame, *channels: str) -> DataFrame:
    """(image_id, y, an array for each channel in order of x)."""
    rows = df.groupBy("image_id", "y").agg(F.sort_array(F.collect_list(F.struct("x", *channels))).alias("_line"))
    return rows.select("image_id", "y", *[F.col(f"_line.{c}").alias(c) for c in channels])


def pixels_of(scanlines: DataFrame, *channels: str) -> DataFrame:
    """A row for each pixel again."""
    line = scanlines.select("image_id", "y", F.posexplode(F.arrays_zip(*channels)).alias("x", "_v"))
    return line.select("image_id", "y", "x", *[F.col(f"_v.{c}").alias(c) for c in channels])
