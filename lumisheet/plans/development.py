"""The development of an image from linear RGB to display values, as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import encode_srgb, exposure, local_contrast, luminance_bw, zone_system
from ..presets import GuidedFilterParams, ZoneParams


@dataclass(frozen=True)
class Development:
    """Exposure, one conversion to luminance, zones, local contrast and encoding, in this order.

    All pixel-wise steps fuse into one stage on either side of the window step.
    """

    stops: float = 0.0
    convert: Callable[[DataFrame], DataFrame] = luminance_bw
    zones: ZoneParams = field(default_factory=ZoneParams)
    contrast: GuidedFilterParams | None = None
    strength: float = 0.5
    method: str | None = "tiles"

    def __call__(self, rgb: DataFrame) -> DataFrame:
        lit = exposure(rgb, self.stops, "r", "g", "b") if self.stops else rgb
        toned = zone_system(self.convert(lit), self.zones)
        if self.contrast:
            toned = local_contrast(toned, self.contrast, self.strength, method=self.method)
        return encode_srgb(toned, "l")
