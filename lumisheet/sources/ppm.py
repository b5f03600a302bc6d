"""Binary PPM files (P6, 8 bits), for one image at a time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..errors import ShapeError
from ..operators import grey_to_rgb, quantize_u8
from .arrays import to_numpy


def ppm_bytes(df: DataFrame) -> bytes:
    """One image as a PPM file: RGB, or luminance as equal channels; values are clamped to 0..1."""
    rgb = grey_to_rgb(df) if "l" in df.columns else df
    pixels = to_numpy(quantize_u8(rgb, "r", "g", "b"), "r", "g", "b")
    if np.isnan(pixels).any():
        raise ShapeError("the image is no dense grid")
    return f"P6\n{pixels.shape[1]} {pixels.shape[0]}\n255\n".encode() + pixels.astype(np.uint8).tobytes()


def write_ppm(df: DataFrame, path: str) -> None:
    """``ppm_bytes`` in a file on the driver."""
    with open(path, "wb") as f:
        f.write(ppm_bytes(df))
