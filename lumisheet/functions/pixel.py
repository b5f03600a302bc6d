"""Column expressions of single pixels; all stay in whole-stage code generation.

Dot products and the linear branch of the transfer function are FLOAT throughout; logarithms, powers and
exponentials are DOUBLE and cast once at the end.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MIDDLE_GREY = 0.18
FLOOR = 1e-10  # keeps the logarithm finite
TWO_SIGMA_SQUARED = 2 * 0.8 * 0.8
SRGB_THRESHOLD = 0.0031308


def lit32(value: float) -> Column:
    """A FLOAT literal; a plain one would widen the expression to DOUBLE."""
    return F.lit(float(value)).cast("float")


def dot(channels: Sequence[str | Column], weights: Sequence[float]) -> Column:
    """Weighted sum of channels, left to right, in FLOAT."""
    terms = [lit32(w) * (F.col(c) if isinstance(c, str) else c) for c, w in zip(channels, weights, strict=True)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def filtered_weights(transmission: Sequence[float], weights: Sequence[float]) -> list[float]:
    """Products of transmission and weight, each rounded to FLOAT before it meets a channel."""
    return [float(np.float32(t) * np.float32(w)) for t, w in zip(transmission, weights, strict=True)]


def zone_position(l: Column) -> Column:
    """Zone of a luminance: 5 is middle grey, one zone a stop."""
    return 5.0 + F.ln(F.greatest(l.cast("double"), F.lit(FLOOR))) / F.lit(math.log(2)) - F.lit(math.log(MIDDLE_GREY) / math.log(2))


def zone_tone(l: Column, position: Column, offsets: Mapping[int, float]) -> Column:
    """Luminance times two to the sum of the offsets, each weighed by a Gaussian round its zone."""
    stops = F.lit(0.0)
    for zone, stop in sorted(offsets.items()):
        d = position - F.lit(float(zone))
        stops = stops + F.lit(float(np.float32(stop))) * F.exp(-(d * d) / F.lit(TWO_SIGMA_SQUARED))
    return (l.cast("double") * F.pow(F.lit(2.0), stops)).cast("float")


def encode_transfer(c: Column) -> Column:
    """sRGB transfer function, without clamping."""
    power = (F.lit(1.055) * F.pow(c.cast("double"), F.lit(1 / 2.4)) - F.lit(0.055)).cast("float")
    return F.when(c <= lit32(SRGB_THRESHOLD), lit32(12.92) * c).otherwise(power)


def quantize(c: Column) -> Column:
    """0..255, rounded half up, clamped; NaN gives 0."""
    v = F.nanvl(c.cast("double"), F.lit(0.0))
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255 + 0.5).cast("int")


def box_area(y: Column, x: Column, height: Column, width: Column, radius: int) -> Column:
    """Cells of the window round a pixel that lie in the image."""

    def side(at: Column, size: Column) -> Column:
        return F.least(at + radius, size - 1) - F.greatest(at - radius, F.lit(0)) + 1

    return side(y, height).cast("long") * side(x, width).cast("long")
