"""Presets and parameters of the raster operators."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from enum import IntEnum
from types import MappingProxyType

from pyspark.sql import DataFrame, SparkSession

Triple = tuple[float, float, float]


class LuminanceStandard(IntEnum):
    """Luma coefficients of a broadcast standard."""

    Bt601 = 0
    Bt709 = 1
    Bt2020 = 2

    def weights(self) -> Triple:
        return _WEIGHTS[self]


class ColorFilter(IntEnum):
    """A photographic filter in front of a panchromatic film."""

    NoFilter = 0
    Yellow8K2 = 1
    Orange21 = 2
    Red25A = 3
    Green11X1 = 4
    Blue47C5 = 5

    def transmission(self) -> Triple:
        return _TRANSMISSION[self]


# Luma coefficients of ITU-R BT.601, BT.709 and BT.2020, for red, green and blue.
_WEIGHTS = {
    LuminanceStandard.Bt601: (0.2990, 0.5870, 0.1140),
    LuminanceStandard.Bt709: (0.2126, 0.7152, 0.0722),
    LuminanceStandard.Bt2020: (0.2627, 0.6780, 0.0593),
}

# Transmission of each filter for red, green and blue.
_TRANSMISSION = {
    ColorFilter.NoFilter: (1.00, 1.00, 1.00),
    ColorFilter.Yellow8K2: (1.00, 0.90, 0.30),
    ColorFilter.Orange21: (1.00, 0.55, 0.10),
    ColorFilter.Red25A: (1.00, 0.10, 0.02),
    ColorFilter.Green11X1: (0.20, 1.00, 0.30),
    ColorFilter.Blue47C5: (0.10, 0.30, 1.00),
}


@dataclass(frozen=True)
class ZoneParams:
    """Stops to add at zones; any integer zone and any number of stops."""

    offsets: Mapping[int, float]

    def __init__(self, offsets: Mapping[int, float] | None = None):
        object.__setattr__(self, "offsets", MappingProxyType({int(z): float(s) for z, s in sorted((offsets or {}).items())}))

    def __hash__(self) -> int:
        return hash(tuple(self.offsets.items()))

    def __repr__(self) -> str:
        return "ZoneParams({" + ", ".join(f"{z}: {s:g}" for z, s in self.offsets.items()) + "})"

    @classmethod
    def from_table(cls, zones: DataFrame, max_zones: int = 256) -> ZoneParams:
        """Parameters from a table (zone, stops); more than ``max_zones`` rows are an error, as they become literals."""
        rows = zones.select("zone", "stops").limit(max_zones + 1).collect()
        if len(rows) > max_zones:
            raise ValueError(f"more than {max_zones} zones")
        return cls({r.zone: r.stops for r in rows})


@dataclass
class GuidedFilterParams:
    """Window radius in pixels and regularisation of the guided filter."""

    radius: int
    eps: float

    def __post_init__(self) -> None:
        if self.radius < 0:
            raise ValueError("radius must not be negative")


def standards(spark: SparkSession) -> DataFrame:
    """The standards as a table (name, wr, wg, wb)."""
    return spark.createDataFrame([(s.name, *s.weights()) for s in LuminanceStandard], "name string, wr float, wg float, wb float")


def filters(spark: SparkSession) -> DataFrame:
    """The filters as a table (name, tr, tg, tb)."""
    return spark.createDataFrame([(f.name, *f.transmission()) for f in ColorFilter], "name string, tr float, tg float, tb float")
