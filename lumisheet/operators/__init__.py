"""Operators over image tables: DataFrame in, lazy DataFrame out, keys kept."""

from .brightest import brightest
from .bw import channel_mixer_bw, color_filter_bw, luminance_bw
from .curve import ToneCurve, tone_curve
from .encode import encode_srgb, grey_to_rgb, quantize_u8
from .grain import film_grain
from .hue import hsl_bw
from .joins import asof_join, band_sums, range_join
from .neighborhood import box_mean_var, box_sum, guided_coefficients, guided_filter, local_contrast, sat
from .pyramid import tile_pyramid
from .ranks import equalize, percent_ranks
from .tone import exposure, zone_system

__all__ = [
    "ToneCurve", "asof_join", "band_sums", "box_mean_var", "box_sum", "brightest", "channel_mixer_bw", "color_filter_bw", "encode_srgb", "equalize", "exposure", "film_grain", "grey_to_rgb", "guided_coefficients",
    "guided_filter", "hsl_bw", "local_contrast", "luminance_bw", "percent_ranks", "quantize_u8", "range_join", "sat", "tile_pyramid", "tone_curve", "zone_system",
]
