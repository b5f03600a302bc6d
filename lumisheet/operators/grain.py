"""Film grain from a seed (an extension: the roadmap names it and asks for an explicit seed, but gives no formula).

The random field is a function of (seed, image, place) alone: two integer hashes of 32 bits, one for the line and one
for the cell, whose products fit a BIGINT. So a pixel gets the same grain under any partitioning, order or retry, and the
operator is a projection in one generated stage.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ShapeError
from ..schema import require_channels

MASK = 0xFFFFFFFF
#: Odd multipliers below 2^31: of the two mixing steps, and of the seed, the image (low, high), the line and the column.
MIX = (2146121005, 1540483477)
SPREAD = (668265263, 2024237689, 1181783497, 374761393, 1274126177)
SECOND = 0x68E31DA4


def mixed(h: Column) -> Column:
    """Each bit of a number of 32 bits depends on all of it."""
    a = h.bitwiseXOR(F.shiftright(h, 16))
    b = (a * F.lit(MIX[0])).bitwiseAND(F.lit(MASK))
    c = b.bitwiseXOR(F.shiftright(b, 15))
    d = (c * F.lit(MIX[1])).bitwiseAND(F.lit(MASK))
    return d.bitwiseXOR(F.shiftright(d, 16))


def _times(value: Column, factor: int) -> Column:
    return (value.cast("long").bitwiseAND(F.lit(MASK)) * F.lit(factor)).bitwiseAND(F.lit(MASK))


def film_grain(df: DataFrame, strength: float, seed: int, size: int = 1, l: str = "l") -> DataFrame:
    """``l + strength * sqrt(4 t (1 - t)) * g``, t being l within 0 and 1, and g Gaussian with mean 0 and variance 1.

    With ``size`` over one, g is interpolated between Gaussians on a lattice of that spacing and scaled back to variance 1,
    so grains are that large; pixels further apart than two spacings are independent. Black and white get none.
    NULL and NaN stay what they are; the seed may be any integer of 64 bits.
    """
    require_channels(df, l)
    if size < 1:
        raise ShapeError(f"grains of {size} pixels")
    image = F.col("image_id").cast("long")
    base = (seed & MASK) * SPREAD[0] + (seed >> 32 & MASK) * SPREAD[4] & MASK
    line = lambda y: mixed((F.lit(base) + _times(image, SPREAD[1]) + _times(F.shiftright(image, 32), SPREAD[2]) + _times(y, SPREAD[3])).bitwiseAND(F.lit(MASK)))
    corners = range(2 if size > 1 else 1)
    y, x = (F.floor(F.col(c) / size) for c in ("y", "x"))
    lines = df.withColumns({f"_line{i}": line(y + i) for i in corners})
    cells = lines.withColumns({f"_h{i}{j}": mixed((F.col(f"_line{i}") + _times(x + j, SPREAD[4])).bitwiseAND(F.lit(MASK))) for i in corners for j in corners})
    seconds = cells.withColumns({f"_k{i}{j}": mixed(F.col(f"_h{i}{j}").bitwiseXOR(F.lit(SECOND))) for i in corners for j in corners})
    gauss = lambda i, j: F.sqrt(F.lit(-2.0) * F.ln((F.col(f"_h{i}{j}") + F.lit(0.5)) / F.lit(2.0**32))) * F.cos(F.col(f"_k{i}{j}") * F.lit(2 * math.pi / 2.0**32))
    if size == 1:
        g = gauss(0, 0)
    else:
        fy, fx = (F.pmod(F.col(c), F.lit(size)) / F.lit(float(size)) for c in ("y", "x"))
        wy, wx = (1.0 - fy, fy), (1.0 - fx, fx)
        norm = F.sqrt((wy[0] * wy[0] + wy[1] * wy[1]) * (wx[0] * wx[0] + wx[1] * wx[1]))
        g = reduce(Column.__add__, [wy[i] * wx[j] * gauss(i, j) for i in corners for j in corners]) / norm
    v = F.col(l).cast("double")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    grained = F.when(F.isnan(v), F.col(l)).otherwise((v + F.lit(float(strength)) * F.sqrt(4.0 * t * (1.0 - t)) * g).cast("float"))
    return seconds.withColumn(l, F.when(F.col(l).isNotNull(), grained)).select(*df.columns)
