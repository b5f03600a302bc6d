"""Conversion of RGB images to luminance."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import dot, filtered_weights
from ..presets import ColorFilter, LuminanceStandard
from ..schema import require_channels

RGB = ("r", "g", "b")


def _mixed(df: DataFrame, weights: list[float] | tuple[float, ...], out: str) -> DataFrame:
    kept = [c for c in require_channels(df, *RGB).columns if c not in (*RGB, out)]
    return df.select(*kept, dot(RGB, weights).alias(out))


def luminance_bw(df: DataFrame, standard: LuminanceStandard = LuminanceStandard.Bt709, out: str = "l") -> DataFrame:
    """Luminance by the weights of a standard."""
    return _mixed(df, LuminanceStandard(standard).weights(), out)


def channel_mixer_bw(df: DataFrame, wr: float, wg: float, wb: float, out: str = "l") -> DataFrame:
    """Luminance by given weights, of any sign and sum."""
    return _mixed(df, (wr, wg, wb), out)


def color_filter_bw(df: DataFrame, filter: ColorFilter = ColorFilter.NoFilter, standard: LuminanceStandard = LuminanceStandard.Bt709, out: str = "l") -> DataFrame:
    """Luminance behind a colour filter."""
    return _mixed(df, filtered_weights(ColorFilter(filter).transmission(), LuminanceStandard(standard).weights()), out)
