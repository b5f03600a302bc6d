"""Exposure and zone-based tone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lit32, zone_position, zone_tone
from ..presets import ZoneParams
from ..schema import require_channels


def exposure(df: DataFrame, stops: float, *channels: str) -> DataFrame:
    """Channels times two to the number of stops (an extension: described by the design, not part of its kernels)."""
    require_channels(df, *channels)
    return df.withColumns({c: F.col(c) * lit32(2.0**stops) for c in channels})


def zone_system(df: DataFrame, params: ZoneParams, l: str = "l") -> DataFrame:
    """Luminance lifted or lowered round the zones of ``params``; without offsets the very input."""
    require_channels(df, l)
    if not params.offsets:
        return df
    placed = df.withColumn("_zone", zone_position(F.col(l)))  # once, and used by every term
    return placed.withColumn(l, zone_tone(F.col(l), F.col("_zone"), params.offsets)).drop("_zone")
