"""Images whose pixels arrive in parts: keyed state until an image is whole or its time is over."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..errors import ShapeError
from ..schema import require_channels

#: Timers need a state store with column families.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Small images share a key and its state: as many ids in a row as have so many cells together.
GROUP_CELLS = 1024


def first_closed(image: np.ndarray, t: np.ndarray, cell: np.ndarray, cells: int, wait: int) -> tuple[np.ndarray, ...]:
    """The images that are opened first, one for each id: the places of the pixels held, the image of each row, and when each
    image opens and closes and if it is whole.

    Rows are in order of id, time, cell and values, so a cell takes its earliest pixel (ties: the least values, channel by
    channel). An image closes when its last cell is taken, or ``wait`` after it has opened.
    """
    new = np.r_[True, image[1:] != image[:-1]]
    which, opened = np.cumsum(new) - 1, t[new]
    near = np.flatnonzero(t <= opened[which] + wait)
    near = near[np.lexsort((cell[near], which[near]))]  # stable: of equal cells the first in this order
    held = near[np.r_[True, (which[near][1:] != which[near][:-1]) | (cell[near][1:] != cell[near][:-1])]]
    starts = np.flatnonzero(np.r_[True, which[held][1:] != which[held][:-1]])
    whole = np.diff(np.r_[starts, len(held)]) == cells
    return held, which, opened, np.where(whole, np.maximum.reduceat(t[held], starts), opened + wait), whole


def state_session(spark: SparkSession) -> SparkSession:
    """A session of its own for streams with state: state stores with timers that take no disk ahead, two a core.

    A partition of a stateful stream is a state store for as long as the stream lives, with costs of its own in each
    batch, so their number goes by the cores, not by the partitions of shuffles (of which it takes no more).
    """
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    session.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return session


class _Assembly(StatefulProcessor):
    """State of a key, some images with ids in a row: chunks of pixels as bytes, and a time before which none of them closes (that of the timer)."""

    def __init__(self, channels: list[str], wait: int):
        self.channels, self.wait = channels, wait
        self.names = [f"v{i}" for i in range(len(channels))]  # names that begin with an underscore don't reach a processor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getListState("chunks", "pixels binary")
        self.about = handle.getValueState("about", "timer long")
        self.kind = np.dtype([("image_id", "<i8"), ("micros", "<i8"), ("y", "<i4"), ("x", "<i4"), *[(v, "<f4") for v in self.names]])

    def _load(self) -> np.ndarray:
        rows = np.concatenate([np.frombuffer(c[0], self.kind) for c in self.chunks.get()])
        return rows[np.lexsort([rows[c] for c in (*self.names[::-1], "x", "y", "micros", "image_id")])]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for df in rows:
            chunk = np.empty(len(df), self.kind)
            for c in self.kind.names:
                chunk[c] = df[c].to_numpy()
            self.chunks.appendValue((chunk.tobytes(),))
            first = min(int(chunk["micros"].min()), first) if first is not None else int(chunk["micros"].min())
        timer, old = -(-first // 1000), self.about.get()[0] if self.about.exists() else None
        if old is None or timer < old:  # a pixel changes no closing time before its own
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timer)
            self.about.update((timer,))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        _, height, width, lines, part = key
        cells = (min(height, (part + 1) * lines) - part * lines) * width
        rows, mark = self._load(), timerValues.getCurrentWatermarkInMs()
        left, out, timer = [], [], None
        while len(rows):
            held, which, opened, closed, whole = first_closed(rows["image_id"], rows["micros"], rows["y"].astype(np.int64) * width + rows["x"], cells, self.wait)
            until = -(-closed // 1000)
            gone = until <= mark
            if not gone.all():  # these images are still open
                left.append(rows[~gone[which]])
                timer = min(int(until[~gone].min()), timer) if timer is not None else int(until[~gone].min())
            own = held[gone[which[held]]]
            out.append((rows[own], opened[which[own]], closed[which[own]], whole[which[own]]))
            rows = rows[gone[which] & (rows["micros"] > closed[which])]
        kept, opened, closed, whole = (np.concatenate(c) for c in zip(*out))
        if len(kept):
            self.chunks.clear()
            if left:
                self.chunks.appendValue((np.concatenate(left).tobytes(),))
        if timer is None:
            self.about.clear()
        else:
            self.handle.registerTimer(timer)
            self.about.update((timer,))
        if len(kept):
            yield pd.DataFrame({
                "image_id": kept["image_id"], "y": kept["y"], "x": kept["x"], **{v: kept[v] for v in self.names},
                "part": np.full(len(kept), part, np.int32), "opened": opened, "closed": closed, "whole": whole,
            })

    def close(self) -> None:
        pass


def assemble(stream: DataFrame, *channels: str, wait: str = "1 hour", delay: str = "10 minutes", lines: int | None = None, ts: str = "ts") -> DataFrame:
    """A stream of single pixels as a stream of images: ``image_id, y, x``, the channels, ``part, opened, closed, whole``.

    ``stream`` has ``image_id, y, x``, FLOAT channels, the declared ``height`` and ``width`` of the image and the time ``ts``
    of each pixel. An image opens with its earliest pixel and closes when its last cell is taken (``whole``) or ``wait``
    after it has opened. It leaves, with all its pixels and once only, when the watermark (the latest time less ``delay``) has
    passed that time, so a result depends on the times of pixels, not on how they are cut into batches.

    * A cell takes its earliest pixel (ties: the least values); others of that cell up to the closing time are dropped.
    * A pixel after the closing time opens the image anew: a second image with the same id.
    * Pixels behind the watermark that the batch before has worked with are late and dropped (no image is open there), as are those outside the grid or with NULL in a key, size or time.
    * NaN, infinite and NULL channels: infinities stay, NaN and NULL come out as NULL. Rows of unlike declared sizes are
      unlike images. An image without a pixel doesn't leave.

    ``lines`` cuts images into parts of so many lines that are whole and leave each on its own: an image of any size is then
    spread over tasks. None: whole images, one part. State is the pixels of the last ``wait`` and ``delay``; a closed image
    leaves none. A task holds the pixels of one key: an image (or a part of it), or several small ones, whose ids
    follow each other, of ``GROUP_CELLS`` cells together; ids far apart have a key each, which is right but slower. The session is one of ``state_session``, or
    has at least ``spark.sql.streaming.stateStore.providerClass`` = ``PROVIDER``.
    """
    require_channels(stream, *channels)
    for c in ("height", "width", ts):
        if c not in stream.columns:
            raise ShapeError(f"no column {c} in {stream.columns}")
    if not channels or (lines is not None and lines < 1):
        raise ShapeError(f"parts of {lines} lines, channels {channels}")
    spark = stream.sparkSession
    gap = spark.range(1).select((F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {wait}"))).alias("w")).collect()[0].w
    size = F.lit(lines) if lines else F.greatest(F.col("height").cast("int"), F.lit(1))
    names = [f"v{i}" for i in range(len(channels))]
    sized = stream.select(
        F.col("image_id").cast("long").alias("image_id"), *[F.col(c).cast("int").alias(c) for c in ("height", "width", "y", "x")], 
        *[F.col(c).alias(v) for v, c in zip(names, channels)], F.col(ts).alias("ts"), F.unix_micros(F.col(ts)).alias("micros"), size.cast("int").alias("lines")
    )
    inside = sized.where("image_id is not null and micros is not null and y >= 0 and y < height and x >= 0 and x < width").withColumn("part", F.floor(F.col("y") / F.col("lines")).cast("int"))
    cells = F.least("height", "lines").cast("long") * F.col("width")
    inside = inside.withColumn("ids", F.greatest(F.floor(F.lit(GROUP_CELLS) / cells), F.lit(1))).withColumn("images", F.expr("image_id div ids"))
    schema = "image_id long, y int, x int, " + ", ".join(f"{v} float" for v in names) + ", part int, opened long, closed long, whole boolean"
    groups = inside.withWatermark("ts", delay).groupBy("images", "height", "width", "lines", "part")
    out = groups.transformWithStateInPandas(_Assembly(list(channels), gap), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return out.select("image_id", "y", "x", *[F.col(v).alias(c) for v, c in zip(names, channels)], "part", F.timestamp_micros("opened").alias("opened"), F.timestamp_micros("closed").alias("closed"), "whole")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only where that is unset in a local session."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if top is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="stream-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def assembled(stream: DataFrame, folder: str, *channels: str, **options) -> DataFrame:
    """``assemble`` over all that the stream has now, written once to ``folder`` (state beside it) and read back."""
    out = assemble(stream, *channels, **options)
    out.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(out.schema).parquet(f"{folder}/out")
