"""Development of streamed pixels.

Pixel-wise operators are stateless and run on a stream as they are. Neighbourhood operators need whole
images, which a micro-batch holds if each file or message carries whole images.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def develop_pixels(stream: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stream through pixel-wise steps; still a stream."""
    for step in steps:
        stream = stream.transform(step)
    return stream


def develop_batches(stream: DataFrame, develop: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Each micro-batch of whole images through any development, as Parquet under ``path``.

    A batch has a folder of its own that a retry overwrites, so results are exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        develop(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
