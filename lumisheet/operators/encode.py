"""Output encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import encode_transfer, quantize
from ..schema import require_channels


def encode_srgb(df: DataFrame, *channels: str) -> DataFrame:
    """Channels through the sRGB transfer function; out-of-range values pass unclamped."""
    require_channels(df, *channels)
    return df.withColumns({c: encode_transfer(F.col(c)) for c in channels})


def quantize_u8(df: DataFrame, *channels: str) -> DataFrame:
    """Channels as integers from 0 to 255."""
    require_channels(df, *channels)
    return df.withColumns({c: quantize(F.col(c)) for c in channels})


def grey_to_rgb(df: DataFrame, l: str = "l") -> DataFrame:
    """A luminance image as an RGB image with three equal channels."""
    require_channels(df, l)
    return df.withColumns({c: F.col(l) for c in ("r", "g", "b")}).drop(*[l] if l not in ("r", "g", "b") else [])
