"""Statistics of a pyramid of tiles (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import require_channels


def tile_pyramid(df: DataFrame, tile: int = 8, levels: int = 4, l: str = "l") -> DataFrame:
    """``image_id, level, ty, tx`` with ``n, mean, variance, low, high`` of luminance; tiles double their side from level to level.

    Pixels are aggregated once, to mergeable parts (count, sums, least, largest) of the smallest tiles, map-side first. All
    levels are rolled up from these rows, so pixels are read and shuffled once whatever the number of levels. NULL
    pixels count for nothing, and tiles without others have no row; the variance is that of a population, not below 0.
    """
    require_channels(df, l)
    v = F.col(l).cast("double")
    parts = df.where(v.isNotNull()).groupBy("image_id", F.floor(F.col("y") / tile).alias("ty"), F.floor(F.col("x") / tile).alias("tx"))
    finest = parts.agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.min(l).alias("low"), F.max(l).alias("high"))
    rolled = finest.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"), "ty", "tx", "n", "s", "q", "low", "high")
    up = lambda c: F.expr(f"shiftright({c}, level)").cast("int").alias(c)
    sums = rolled.groupBy("image_id", "level", up("ty"), up("tx")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("low").alias("low"), F.max("high").alias("high"))
    mean = F.col("s") / F.col("n")
    return sums.select("image_id", "level", "ty", "tx", "n", mean.alias("mean"), F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean).alias("variance"), "low", "high")
