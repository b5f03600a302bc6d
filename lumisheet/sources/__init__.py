"""Images from and to tables, arrays, scanlines and PPM files."""

from .arrays import from_numpy, to_numpy
from .fixtures import embeddings_images, events_image, orders_image
from .layout import pixels_of, scanlines_of
from .ppm import ppm_bytes, write_ppm
from .synthetic import color_chart, constant_image, ramp_image

__all__ = ["color_chart", "constant_image", "embeddings_images", "events_image", "from_numpy", "orders_image", "pixels_of", "ppm_bytes", "ramp_image", "scanlines_of", "to_numpy", "write_ppm"]
