"""Images that arrive as streams of pixels."""

from .assembly import assemble, assembled
from .develop import develop_batches, develop_pixels

__all__ = ["assemble", "assembled", "develop_batches", "develop_pixels"]
