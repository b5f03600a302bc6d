"""Percentile tone mapping: exact ranks of all pixels of an image (an extension).

Ranks come by counting, not by sorting an image in one task. Pixels are first counted by value, map-side, so a hot
value is one row. Values fall into radix buckets: sign, exponent and seven bits of the mantissa, in the order of the
numbers. An image has at most some 71,000 buckets and a bucket at most 65,536 unlike values, so the two windows, buckets of an
image and values of a bucket, are bounded however many pixels there are; the first gives the offset of a bucket, the second the
place in it. The 1,000 most frequent values meet their pixels by broadcast; any other value has less than a thousandth of all
pixels and meets them by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import require_channels

HOT_VALUES = 1000
#: The bucket of infinity.
TOP = 1 << 20


def radix(v: Column) -> Column:
    """A whole number that never falls as ``v`` (FLOAT) rises, NaN being the largest; 65,536 unlike values share one at most."""
    wide = v.cast("double")
    size = F.abs(wide)
    # a FLOAT below a power of two is 8e-8 below it in the logarithm, so the small push only mends rounding
    power = F.floor(F.log2(size) + F.lit(1e-9))
    place = (power + 160) * 128 + F.floor(size / F.pow(F.lit(2.0), power.cast("double")) * 128) - 128
    held = F.when(size == 0, F.lit(0).cast("long")).when(size == float("inf"), F.lit(TOP).cast("long")).otherwise(place)
    return F.when(F.isnan(wide), F.lit(2 * TOP).cast("long")).when(wide < 0, -held).otherwise(held)


def value_ranks(df: DataFrame, l: str = "l") -> DataFrame:
    """``image_id``, value ``l``, its pixels ``n``, the pixels ``below`` it and ``total`` of the image; NULL has no rank."""
    counts = df.where(F.col(l).isNotNull()).groupBy("image_id", F.col(l).alias("l")).agg(F.count("*").alias("n")).withColumn("bucket", radix(F.col("l")))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("image_id", "bucket").agg(F.sum("n").alias("held"))
    whole = Window.partitionBy("image_id")
    offsets = sums.select(F.col("image_id").alias("_image"), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("held").over(earlier.partitionBy("image_id")), F.lit(0)).alias("before"), F.sum("held").over(whole).alias("total"))
    inside = Window.partitionBy("image_id", "bucket").orderBy("l").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    same = F.col("image_id").eqNullSafe(F.col("_image")) & (F.col("bucket") == F.col("_bucket"))
    return placed.join(offsets, same).select("image_id", "l", "n", (F.col("before") + F.col("inside")).alias("below"), "total")


def percent_ranks(df: DataFrame, l: str = "l", into: str = "rank") -> DataFrame:
    """``df`` with the share of an image's other pixels that are darker (DOUBLE), as SQL's percent_rank.

    Ties share the rank of their first; an only pixel gets 0; NaN is brighter than all, -0 equals 0; NULL gets NULL and
    counts for nothing.
    """
    require_channels(df, l)
    ranks = value_ranks(df, l).select(F.col("image_id").alias("_image"), F.col("l").alias("_value"), "n", F.when(F.col("total") > 1, F.col("below") / (F.col("total") - 1)).otherwise(F.lit(0.0)).alias("_rank"))
    hot = F.broadcast(ranks.orderBy(F.desc("n"), "_image", "_value").limit(HOT_VALUES).drop("n"))
    same = F.col("image_id").eqNullSafe(F.col("_image")) & (F.col(l) == F.col("_value"))
    kept = [c for c in df.columns if c != into]
    found = df.where(F.col(l).isNotNull()).join(hot, same).select(*kept, F.col("_rank").alias(into))
    rest = df.where(F.col(l).isNotNull()).join(hot, same, "left_anti")
    return found.unionByName(rest.join(ranks, same).select(*kept, F.col("_rank").alias(into))).unionByName(df.where(F.col(l).isNull()).select(*kept, F.lit(None).cast("double").alias(into)))


def equalize(df: DataFrame, amount: float = 1.0, white: float = 1.0, l: str = "l") -> DataFrame:
    """Luminance moved by ``amount`` towards ``white`` times its percentile rank: 1 spreads tones evenly, 0 changes nothing."""
    ranked = percent_ranks(df, l, "_share")
    v = F.col(l).cast("double")
    return ranked.withColumn(l, (v + F.lit(float(amount)) * (F.lit(float(white)) * F.col("_share") - v)).cast("float")).select(*df.columns)
