"""Compositions of operators."""

from .development import Development

__all__ = ["Development"]
