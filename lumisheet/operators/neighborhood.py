"""Box windows, the guided filter, and local contrast.

One rule for all forms: a window is cut at the image border and sums its present pixels; means divide by their
number. A NULL pixel is not present, and has no result of its own. A NaN, or infinities of both signs, make the sums of
the windows that hold them NaN, an infinity makes them infinite, and no other window is touched.

Three physical forms of the same result:

* ``tiles``: pixels go to square tiles with a margin of two radii, and NumPy filters the tiles, small ones of a
  shape together. One shuffle, memory by tile (its side grows with the radius) whatever the image size, work independent of the radius; the default of local contrast. Absent
  rows are pixels that are not present.
* ``sliding``: framed sums along x, then along y, in the JVM. Partitions are single rows and columns, so one huge image
  spreads over the cluster; the work of a pixel grows with the radius. The default of box sums of small radius.
* ``running``: differences of running sums, for large radii.

``sliding`` and ``running`` sum over rows first, so each line of the image must have a row for each column: give
sparse images to ``completed`` before, which adds the absent pixels as NULL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import lit32
from ..presets import GuidedFilterParams
from ..schema import require_channels

#: Radius from which running sums are taken where the caller does not say.
RUNNING_FROM = 32
#: Pixels in a list that travels to a tile, and pixels that go through NumPy at a time (or one tile).
LIST, STACK = 256, 1 << 18


def sat(df: DataFrame, value: str = "l", out: str = "sat") -> DataFrame:
    """Summed-area table: the sum over all pixels above and to the left, inclusive, in DOUBLE."""
    along = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_row", F.sum(F.col(value).cast("double")).over(along)).withColumn(out, F.sum("_row").over(down)).drop("_row")


def box_sum(df: DataFrame, values: dict[str, str], radius: int, method: str | None = None, rows_first: bool = True) -> DataFrame:
    """Sums in DOUBLE over the window of a pixel: ``values`` names input column and output column.

    A box leaves the pixels partitioned by its second direction. One that follows saves a shuffle by starting with it
    (``rows_first`` false).
    """
    method = method or ("running" if radius >= RUNNING_FROM else "sliding")
    if method not in ("sliding", "running"):
        raise ValueError(f"no such method: {method}")
    step = _sliding if method == "sliding" else _running
    line, along = ("y", "x") if rows_first else ("x", "y")
    rows = step(df, {c: f"_row_{out}" for c, out in values.items()}, radius, line, along)
    return step(rows, {f"_row_{out}": out for out in values.values()}, radius, along, line).drop(*[f"_row_{out}" for out in values.values()])


def _sliding(df: DataFrame, values: dict[str, str], radius: int, line: str, along: str) -> DataFrame:
    frame = Window.partitionBy("image_id", line).orderBy(along).rangeBetween(-radius, radius)
    return df.withColumns({out: F.sum(F.col(c).cast("double")).over(frame) for c, out in values.items()})


#: Fields of a number that counts NaN, infinities and negative infinities of a window.
_NAN, _PLUS, _MINUS = 1, 1 << 21, 1 << 42


def _running(df: DataFrame, values: dict[str, str], radius: int, line: str, along: str) -> DataFrame:
    """The running sum up to the end of a window less that before it, of finite values; the others are counted beside."""
    order = Window.partitionBy("image_id", line).orderBy(along)
    upto, before = (order.rangeBetween(Window.unboundedPreceding, at) for at in (radius, -radius - 1))
    inf = float("inf")
    split, out = {}, {}
    for c, name in values.items():
        x = F.col(c).cast("double")
        split[f"_s_{name}"] = F.when(F.isnan(x), _NAN).when(x == inf, _PLUS).when(x == -inf, _MINUS).otherwise(0).cast("long")
        split[f"_f_{name}"] = F.when(F.isnan(x) | (F.abs(x) == inf), 0.0).otherwise(x)
        split[f"_p_{name}"] = x.isNotNull().cast("long")
        window = lambda part: F.sum(part).over(upto) - F.coalesce(F.sum(part).over(before), F.lit(0))
        strange = window(f"_s_{name}")
        plus, minus = F.shiftright(strange, 21).bitwiseAND(F.lit(_PLUS - 1)) > 0, F.shiftright(strange, 42) > 0
        total = F.when(strange == 0, window(f"_f_{name}")).when((strange.bitwiseAND(F.lit(_PLUS - 1)) > 0) | (plus & minus), float("nan")).when(plus, inf).otherwise(-inf)
        out[name] = F.when(window(f"_p_{name}") > 0, total)
    return df.withColumns(split).withColumns(out).drop(*split)


def _boxed(df: DataFrame, values: dict[str, str], radius: int, method: str | None, present: str, rows_first: bool = True) -> DataFrame:
    """``box_sum`` with the count of the window's present pixels as ``_n``."""
    one = F.when(F.col(present).isNotNull(), lit32(1.0))
    return box_sum(df.withColumn("_one", one), values | {"_one": "_n"}, radius, method, rows_first).drop("_one")


def box_mean_var(df: DataFrame, radius: int, l: str = "l", method: str | None = None) -> DataFrame:
    """``mean`` and ``variance`` of the window, the latter as mean of squares less squared mean (squares in FLOAT)."""
    require_channels(df, l)
    squared = df.withColumn("_square", F.col(l) * F.col(l))
    sums = _boxed(squared, {l: "_sum", "_square": "_sum2"}, radius, method, l)
    mean = F.col("_sum") / F.col("_n")
    return sums.withColumn("mean", mean).withColumn("variance", F.col("_sum2") / F.col("_n") - F.col("mean") * F.col("mean")).drop("_square", "_sum", "_sum2", "_n")


def guided_coefficients(df: DataFrame, params: GuidedFilterParams, l: str = "l", method: str | None = None) -> DataFrame:
    """Slope ``a`` and offset ``b`` of the local linear model, FLOAT."""
    eps = F.lit(float(np.float32(params.eps)))
    v = F.col("variance")
    model = box_mean_var(df, params.radius, l, method).withColumn("_a", F.when(v + eps > 0, v / (v + eps)).otherwise(F.lit(0.0)))
    own = lambda c: F.when(F.col(l).isNotNull(), c.cast("float"))
    return model.withColumn("b", own(F.col("mean") * (1.0 - F.col("_a")))).withColumn("a", own(F.col("_a"))).drop("_a", "mean", "variance")


def guided_filter(df: DataFrame, params: GuidedFilterParams, l: str = "l", out: str = "q", method: str | None = None) -> DataFrame:
    """Edge-preserving smoothing of the luminance by itself."""
    sums = _boxed(guided_coefficients(df, params, l, method), {"a": "_a", "b": "_b"}, params.radius, method, l, rows_first=False)
    q = F.col("_a") / F.col("_n") * F.col(l).cast("double") + F.col("_b") / F.col("_n")
    return sums.withColumn(out, q.cast("float")).drop("a", "b", "_a", "_b", "_n")


def local_contrast(df: DataFrame, params: GuidedFilterParams, strength: float, l: str = "l", method: str = "tiles", tile: int = 256) -> DataFrame:
    """Luminance plus ``strength`` times what the guided filter takes away. ``method`` is tiles, sliding or running."""
    require_channels(df, l)
    if method == "tiles":
        return _tiled(df, params, strength, l, tile)
    return guided_filter(df, params, l, "_q", method).withColumn(l, F.col(l) + lit32(strength) * (F.col(l) - F.col("_q"))).drop("_q")


def _tiled(df: DataFrame, params: GuidedFilterParams, strength: float, l: str, tile: int) -> DataFrame:
    """Tiles with a margin of two radii: the filter averages coefficients that themselves come from windows.

    The pixels of a batch that go to one tile are rows of lists (of ``LIST`` pixels at most, which bounds a batch of
    them), so the shuffle has few and compact rows. A task goes through its tiles in order, many small ones at a time.
    Memory is that of the tile, whose side is at least two radii.
    """
    margin = 2 * params.radius
    tile = max(tile, margin, 1)
    radius, eps, k32 = params.radius, float(np.float32(params.eps)), np.float32(strength)
    rest = [f for f in df.schema.fields if f.name != "image_id"]
    keys = [df.schema["image_id"], T.StructField("_ty", T.IntegerType()), T.StructField("_tx", T.IntegerType())]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            image, y, x = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("image_id", "y", "x"))
            (y0, y1), (x0, x1) = ((np.maximum(at - margin, 0) // tile, (at + margin) // tile) for at in (y, x))
            parts = []
            for a in range(int((y1 - y0).max(initial=-1)) + 1):
                for b in range(int((x1 - x0).max(initial=-1)) + 1):
                    own = np.flatnonzero((y0 + a <= y1) & (x0 + b <= x1))
                    parts.append((own, y0[own] + a, x0[own] + b))
            if not parts:
                continue
            row, ty, tx = (np.concatenate(p) for p in zip(*parts, strict=True))
            order = np.lexsort((tx, ty, image[row]))
            row, ty, tx = row[order], ty[order], tx[order]
            key = image[row]
            first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (ty[1:] != ty[:-1]) | (tx[1:] != tx[:-1]))))
            within = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
            first = np.flatnonzero(within % LIST == 0)
            offsets, at = pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(row)
            lists = [pa.ListArray.from_arrays(offsets, batch.column(f.name).take(at)) for f in rest]
            yield pa.RecordBatch.from_arrays([batch.column("image_id").take(pa.array(row[first])), pa.array(ty[first].astype(np.int32)), pa.array(tx[first].astype(np.int32)), *lists], names=[f.name for f in (*keys, *rest)])

    names = df.columns

    def develop(rows: pa.Table) -> pa.RecordBatch:
        """The pixels of whole tiles (sorted by tile); tiles of one shape, as small images are, go through NumPy together."""
        flat = {f.name: pc.list_flatten(rows.column(f.name).combine_chunks()) for f in rest}
        length = pc.list_value_length(rows.column("y")).to_numpy()
        at = np.repeat(np.arange(rows.num_rows), length)
        y, x = flat["y"].to_numpy(), flat["x"].to_numpy()
        own = (y // tile == rows.column("_ty").to_numpy()[at]) & (x // tile == rows.column("_tx").to_numpy()[at])
        lum, has, new = flat[l].fill_null(0).to_numpy(), flat[l].is_valid().to_numpy(zero_copy_only=False), np.zeros(len(y), np.float32)
        first = np.append(0, np.cumsum(length))[np.append(_starts(rows), rows.num_rows)]
        first = first[np.append(True, first[1:] > first[:-1])]
        top, bottom, left, right = (f.reduceat(c, first[:-1]) if len(y) else y for c in (y, x) for f in (np.minimum, np.maximum))
        shapes: dict[tuple[int, int], list[int]] = {}
        for i, shape in enumerate(zip((bottom - top + 1).tolist(), (right - left + 1).tolist(), strict=True)):
            if own[first[i] : first[i + 1]].any():  # else a margin beyond the image
                shapes.setdefault(shape, []).append(i)
        for (height, width), tiles in shapes.items():
            step = max(1, STACK // (height * width))
            for k in range(0, len(tiles), step):
                some = tiles[k : k + step]
                px = np.concatenate([np.arange(first[i], first[i + 1]) for i in some])
                n = np.repeat(np.arange(len(some)), [first[i + 1] - first[i] for i in some])
                cell = (n, y[px] - top[some][n], x[px] - left[some][n])
                plane, present = np.zeros((len(some), height, width), np.float32), np.zeros((len(some), height, width), bool)
                plane[cell], present[cell] = np.where(has[px], lum[px], 0), has[px]
                with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
                    new[px] = lum[px] + k32 * (lum[px] - _guided(plane, present, radius, eps)[cell])
        mine = np.flatnonzero(own)
        out = {c: v.take(pa.array(mine)) for c, v in flat.items()} | {l: pa.array(new[mine], mask=~has[mine])}
        out["image_id"] = rows.column("image_id").combine_chunks().take(pa.array(at[mine]))
        return pa.RecordBatch.from_arrays([out[c] for c in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            last = int(_starts(rows)[-1]) if rows.num_rows else 0
            if last:
                yield develop(rows.slice(0, last))
            held = rows.slice(last)  # the next batch may go on with this tile
        if held is not None and held.num_rows:
            yield develop(held)

    packed = T.StructType([*keys, *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in rest]])
    tiles = df.mapInArrow(pack, packed).repartition("image_id", "_ty", "_tx").sortWithinPartitions("image_id", "_ty", "_tx")
    return tiles.mapInArrow(run, T.StructType(df.schema.fields))


def _starts(rows: pa.Table) -> np.ndarray:
    """The first row of each tile."""
    image = rows.column("image_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    key = np.stack((image, rows.column("_ty").to_numpy(), rows.column("_tx").to_numpy()))
    return np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))) if rows.num_rows else np.zeros(0, np.int64)


def _sums(plane: np.ndarray, radius: int) -> np.ndarray:
    """Window sums of a plane or a stack of planes, cut at the border, in double."""
    out = plane.astype(np.float64)
    for axis in (-1, -2):
        s = np.concatenate((np.zeros_like(out.take([0], axis)), out.cumsum(axis)), axis)
        at = np.arange(out.shape[axis])
        out = s.take(np.minimum(at + radius, len(at) - 1) + 1, axis) - s.take(np.maximum(at - radius, 0), axis)
    return out


def _box(plane: np.ndarray, radius: int) -> np.ndarray:
    """``_sums`` of finite values; the others are counted beside, so that they stay within the windows that hold them."""
    strange = ~np.isfinite(plane)
    if not strange.any():
        return _sums(plane, radius)
    out = _sums(np.where(strange, 0, plane), radius)
    nan, plus, minus = (_sums(x, radius) > 0.5 for x in (np.isnan(plane), plane == np.inf, plane == -np.inf))
    out[plus], out[minus] = np.inf, -np.inf
    out[nan | (plus & minus)] = np.nan
    return out


def _guided(plane: np.ndarray, present: np.ndarray, radius: int, eps: float) -> np.ndarray:
    n = _sums(present, radius)
    mean = _box(plane, radius) / n
    variance = _box(plane * plane, radius) / n - mean * mean
    room = variance + eps
    a = np.divide(variance, room, out=np.zeros_like(room), where=~(room <= 0))
    b = mean * (1.0 - a)
    a, b = (np.where(present, x, 0).astype(np.float32) for x in (a, b))
    return (_box(a, radius) / n * plane.astype(np.float64) + _box(b, radius) / n).astype(np.float32)
