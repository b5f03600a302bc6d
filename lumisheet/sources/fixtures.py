"""Images derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One RGB image, 150 pixels wide, a pixel for each order."""
    key = F.col("o_orderkey")
    return _read(spark, sf_dir, "orders").select(
        F.lit(0).cast("long").alias("image_id"),
        F.floor(key / 150).cast("int").alias("y"),
        (key % 150).cast("int").alias("x"),
        (F.col("o_totalprice").cast("double") / 500000.0).cast("float").alias("r"),
        ((F.col("o_custkey") % 256) / F.lit(255.0)).cast("float").alias("g"),
        (F.substring("o_orderpriority", 1, 1).cast("int") / F.lit(5.0)).cast("float").alias("b"),
    )


def events_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One luminance image, 100 pixels wide, a pixel for each event; values run from dark to beyond white."""
    key = F.col("event_id")
    return _read(spark, sf_dir, "events").select(
        F.lit(0).cast("long").alias("image_id"),
        F.floor(key / 100).cast("int").alias("y"),
        (key % 100).cast("int").alias("x"),
        (F.col("value").cast("double") / 100.0).cast("float").alias("l"),
    )


def embeddings_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8 x 8 luminance image for each vector of 64 numbers, with negative values."""
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("pos", "l")).select(
        "image_id", F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).cast("int").alias("x"), F.col("l").cast("float").alias("l")
    )
