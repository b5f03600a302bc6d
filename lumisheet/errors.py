"""Errors of the raster operators."""


class ShapeError(ValueError):
    """An image lacks a channel, holds another type, or is no dense grid."""

    def __init__(self, message: str):
        super().__init__(f"shape error: {message}")
