"""Column expressions of single pixels."""

from .pixel import box_area, dot, encode_transfer, filtered_weights, lit32, quantize, zone_position, zone_tone

__all__ = ["box_area", "dot", "encode_transfer", "filtered_weights", "lit32", "quantize", "zone_position", "zone_tone"]
