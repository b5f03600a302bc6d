"""NumPy arrays in and out, one image at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..errors import ShapeError

_NAMES = {1: ("l",), 3: ("r", "g", "b")}


def from_numpy(spark: SparkSession, array: np.ndarray, image_id: int = 0) -> DataFrame:
    """A FLOAT array of shape (H, W, 1) or (H, W, 3) as pixels; other types and shapes are errors."""
    if array.ndim != 3 or array.shape[2] not in _NAMES:
        raise ShapeError(f"expected (H, W, 1) or (H, W, 3), got {array.shape}")
    if array.dtype != np.float32:
        raise ShapeError(f"expected float32, got {array.dtype}")
    h, w, c = array.shape
    y, x = np.divmod(np.arange(h * w, dtype=np.int32), max(1, w))
    flat = array.reshape(-1, c)
    names = _NAMES[c]
    schema = "image_id long, y int, x int, " + ", ".join(f"{n} float" for n in names)
    return spark.createDataFrame(pd.DataFrame({"image_id": np.full(h * w, image_id, np.int64), "y": y, "x": x} | {n: flat[:, k] for k, n in enumerate(names)}), schema)


def to_numpy(df: DataFrame, *channels: str) -> np.ndarray:
    """The pixels of one image as an array of shape (H, W, C); it must fit in the driver."""
    pdf = df.select("y", "x", *channels).toPandas()
    if pdf.empty:
        return np.zeros((0, 0, len(channels)), np.float32)
    out = np.full((int(pdf.y.max()) + 1, int(pdf.x.max()) + 1, len(channels)), np.nan, np.float32)
    out[pdf.y, pdf.x] = pdf[list(channels)].to_numpy(np.float32)
    return out
