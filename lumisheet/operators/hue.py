"""Black-and-white conversion by eight hue bands (an extension)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ShapeError
from ..functions import dot
from ..presets import LuminanceStandard
from ..schema import require_channels

BANDS = ("red", "orange", "yellow_green", "green", "cyan", "blue", "violet", "magenta")


def hsl_bw(df: DataFrame, stops: Sequence[float], standard: LuminanceStandard = LuminanceStandard.Bt709) -> DataFrame:
    """Luminance times ``2 ** (s * gain)``: s is the HSL saturation, gain the stops of the two bands round the hue.

    Bands stand at 0, 45, ... 315 degrees. A hue between two of them takes both, in proportion to its distance, so weights
    sum to one everywhere and the wrap at red is continuous. Greys have no saturation and stay plain luminance. Channels
    are held within 0 and 1 for hue and saturation only.
    """
    require_channels(df, "r", "g", "b")
    if len(stops) != len(BANDS):
        raise ShapeError(f"{len(stops)} stops for {len(BANDS)} hue bands")
    keys = [c for c in df.columns if c not in ("r", "g", "b", "l")]
    held = {c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c).cast("double"))) for c in "rgb"}
    plain = df.select(*keys, dot(("r", "g", "b"), standard.weights()).alias("l"), *[v.alias(f"_{c}") for c, v in held.items()])
    r, g, b = (F.col(f"_{c}") for c in "rgb")
    ends = plain.withColumns({"_top": F.greatest(r, g, b), "_low": F.least(r, g, b)})
    top, low, wide = F.col("_top"), F.col("_low"), F.col("_top") - F.col("_low")
    side = F.when(top == r, (g - b) / wide).when(top == g, (b - r) / wide + 2.0).otherwise((r - g) / wide + 4.0)
    # sixths of the circle to eighths; a hue just below zero wraps
    hue = F.when(wide > 0, F.pmod(side, F.lit(6.0)) * F.lit(8.0 / 6.0))
    saturation = F.when(wide > 0, wide / (1.0 - F.abs(top + low - 1.0)))
    placed = ends.withColumns({"_hue": hue, "_s": saturation})
    spread = placed.withColumns({"_band": (F.floor("_hue") % 8).cast("int"), "_f": F.col("_hue") - F.floor("_hue")})
    table = [F.array(*[F.lit(float(s)) for s in [*stops[k:], *stops[:k]]]) for k in (0, 1)]
    gain = F.get(table[0], F.col("_band")) * (1.0 - F.col("_f")) + F.get(table[1], F.col("_band")) * F.col("_f")
    lifted = (F.col("l").cast("double") * F.pow(F.lit(2.0), F.col("_s") * gain)).cast("float")
    return spread.select(*keys, F.when(F.col("_s").isNull(), F.col("l")).otherwise(lifted).alias("l"))
