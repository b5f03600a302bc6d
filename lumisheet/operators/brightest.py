"""The brightest pixels of each tile (an extension)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..errors import ShapeError
from ..schema import require_channels

#: Rows that a task holds before it hands them on and starts anew.
HELD = 1 << 18


def _first(rows: pa.Table, k: int, tile: int) -> pa.Table:
    """The k brightest rows of each tile (columns image_id, y, x, l come first), in the order of the result."""
    image, y, x, l = (rows.column(i).to_numpy() for i in range(4))
    ty, tx = y // tile, x // tile
    strange = np.isnan(l)
    order = np.lexsort((x, y, -np.where(strange, 0, l), ~strange, tx, ty, image))
    key = np.stack((image[order], ty[order], tx[order]))
    new = np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0)))
    start = np.flatnonzero(new)
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return rows.take(pa.array(order[place < k]))


def brightest(df: DataFrame, k: int, tile: int = 8, l: str = "l") -> DataFrame:
    """``image_id, ty, tx, place, y, x`` and luminance of the ``k`` brightest pixels of each tile; place runs from 1.

    Ties go by line, then column; NaN is brighter than all; NULL pixels take no part; a tile with fewer pixels gives all
    of them. Tasks keep the best k of each tile they read and send only those, so a tile gets at most k rows from a task
    (a task that reads very many tiles sends its share each time it holds ``HELD`` rows), and the last choice is a window
    over these rows.
    """
    require_channels(df, l)
    if k < 1 or tile < 1:
        raise ShapeError(f"{k} pixels of tiles of {tile}")
    rows = df.where(F.col(l).isNotNull()).select(F.col("image_id").cast("long").alias("image_id"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col(l).alias("l"))
    rows = rows.where("image_id is not null and y is not null and x is not null")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                own = _first(pa.Table.from_batches([batch]), k, tile)
                held = own if held is None else _first(pa.concat_tables([held, own]).combine_chunks(), k, tile)
                if held.num_rows >= HELD:
                    yield from held.to_batches()
                    held = None
        if held is not None:
            yield from held.to_batches()

    schema = T.StructType([T.StructField("image_id", T.LongType()), T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField("l", T.FloatType())])
    some = rows.mapInArrow(best, schema)
    at = [F.floor(F.col(c) / tile).cast("int").alias(f"t{c}") for c in "yx"]
    ranked = some.select("*", *at).withColumn("place", F.row_number().over(Window.partitionBy("image_id", "ty", "tx").orderBy(F.desc("l"), "y", "x")))
    return ranked.where(F.col("place") <= k).select("image_id", "ty", "tx", "place", "y", "x", F.col("l").alias(l))
