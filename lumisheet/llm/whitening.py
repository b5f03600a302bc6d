"""Whitening of vectors by a covariance in two passes.

An entry ``c`` becomes the whole number ``x = floor(64 c) + 1000000``. The first pass sums ``x`` by dimension in
integers, so the mean is exact whatever the partitioning. The second pass subtracts it, as ``(n x - S) / n`` with the
difference taken in integers, and sums outer products with one matrix product a batch. Tasks emit a vector or a
matrix each, which ``treeAggregate`` merges on executors in levels, so the driver gets a few of them whatever the
number of tasks. LAPACK's symmetric solver splits the matrix (dimensions x dimensions, never rows) on the driver;
the projection is broadcast. A third pass measures the covariance of what the projection gives. No vector is shuffled
or collected, and memory is a matrix and an Arrow batch for each task.

Defined results: rows whose vector is null or holds a null, NaN or infinite entry are dropped; shorter vectors, empty
ones included, count as filled up with zeros to the longest; ``64 c`` is held within +-2^44; ``deviation`` is exact, and
null where it exceeds a long; components whose eigenvalue is not above rounding (constant or dependent dimensions, fewer
rows than dimensions, equal rows) are left out, as nothing can scale them to one; repeated rows and rows without id count
as any other; a table without vectors gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: ``64 c`` beyond this is held at it.
WIDEST = 1 << 44
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    """A fitted projection: rows seen, sums by dimension, the trace, and eigenvalues with unit eigenvectors as columns."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) for v in self.values]


def whole(column: pa.Array, dims: int = 0) -> np.ndarray:
    """Entries of a column of lists as whole numbers, a row for each list, filled up to ``dims`` or the longest."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    width = max(dims, int(sizes.max(initial=0)))
    if len(flat) != width * len(column):
        full = np.zeros((len(column), width))
        full[np.arange(width) < sizes[:, None]] = flat
        flat = full
    with np.errstate(over="ignore"):
        return np.clip(np.floor(flat.reshape(len(column), width) * SCALE), -WIDEST, WIDEST).astype(np.int64) + SHIFT


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """``n x - S`` in integers: machine ones where they hold it, else Python's."""
    if n * (WIDEST if len(x) == 0 else int(np.abs(x).max(initial=0))) + max(map(abs, sums), default=0) < _LONG:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def deviations(away: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exact; None beyond a long."""
    rough = (away.astype(np.float64) ** 2).sum(axis=1)
    if away.dtype != object and rough.max(initial=0) < _LONG / 2:
        return (away * away).sum(axis=1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in away]
    return [v if v <= _LONG else None for v in exact]


def _add_sums(a: tuple[int, list[int]], b: tuple[int, list[int]]) -> tuple[int, list[int]]:
    """Counts and sums together; rows of the shorter one count as filled up."""
    width = max(len(a[1]), len(b[1]))
    filled = [s + [n * SHIFT] * (width - len(s)) for n, s in (a, b)]
    return a[0] + b[0], [p + q for p, q in zip(*filled, strict=True)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: tuple[int, list[int]] = (0, [])
    for batch in batches:
        x = whole(batch.column(0))
        for i in range(0, len(x), 1 << 18):  # 2^18 numbers below 2^45 add up within a long
            total = _add_sums(total, (len(x[i : i + (1 << 18)]), x[i : i + (1 << 18)].sum(axis=0).tolist()))
    yield pa.record_batch([pa.array([pickle.dumps(total)], pa.binary())], ["part"])


def _products(dims: int, of: Callable[[pa.Array], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sum of the outer products of the rows that ``of`` makes of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            d = of(batch.column(0))
            total += d.T @ d
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["part"])

    return run


def _matrix(vectors: DataFrame, dims: int, of: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    parts = vectors.mapInArrow(_products(dims, of), "part binary").rdd.map(lambda r: np.frombuffer(r.part).reshape(dims, dims))
    return parts.treeAggregate(np.zeros((dims, dims)), np.add, np.add)


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is there and holds finite entries only."""
    return df.where(F.col(vector).isNotNull() & F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))


def _entries(df: DataFrame, vector: str) -> DataFrame:
    return usable(df, vector).select(F.col(vector).cast("array<double>").alias("v"))


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """The projection that whitens ``df``; it has at most ``components`` of the largest eigenvalues."""
    vectors = _entries(df, vector)
    n, sums = vectors.mapInArrow(_sums, "part binary").rdd.map(lambda r: pickle.loads(r.part)).treeAggregate((0, []), _add_sums, _add_sums)
    dims, sums = len(sums), tuple(sums)
    if not n or not dims:
        return Whitening(n, sums, 0.0, np.zeros(0), np.zeros((dims, 0)))
    v = _matrix(vectors, dims, lambda column: centred(whole(column, dims), n, sums).astype(np.float64) / n) / n
    values, unit = np.linalg.eigh((v + v.T) / 2)
    values, unit = values[::-1], unit[:, ::-1]
    real = int((values > max(values[0], 0) * dims * np.finfo(float).eps * 16).sum())
    k = min(components, real)
    unit = unit[:, :k] * np.where(unit[np.abs(unit[:, :k]).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)  # one sign for all runs
    return Whitening(n, sums, float(np.trace(v)), values[:k].copy(), unit)


def _projector(model: Whitening) -> Callable[[np.ndarray], np.ndarray]:
    scaled = model.vectors / np.sqrt(model.values)
    return lambda away: away.astype(np.float64) / model.n @ scaled


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """The largest entry by which the covariance of the whitened rows, measured on all of them, differs from the identity."""
    k = len(model.values)
    if not k:
        return 0.0
    shared = df.sparkSession.sparkContext.broadcast(model)

    def of(column: pa.Array) -> np.ndarray:
        m = shared.value
        return _projector(m)(centred(whole(column, len(m.sums)), m.n, m.sums))

    try:
        return float(np.abs(_matrix(_entries(df, vector), k, of) / model.n - np.eye(k)).max())
    finally:
        shared.unpersist()


def whiten(df: DataFrame, model: Whitening, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``key``, ``deviation`` and ``whitened`` (a list with an entry for each component) of each usable row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        project = _projector(m)
        for batch in batches:
            away = centred(whole(batch.column(1), len(m.sums)), m.n, m.sums)
            w = project(away)
            ends = np.arange(len(w) + 1, dtype=np.int32) * np.int32(w.shape[1])
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(w.ravel()))
            yield pa.record_batch([batch.column(0), pa.array(deviations(away), pa.int64()), lists], ["id", "deviation", "whitened"])

    rows = usable(df, vector).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, deviation long, whitened array<double>")
    return out.select(F.col("id").alias(key), "deviation", "whitened")


def digest(vectors: DataFrame) -> DataFrame:
    """A row for each vector and component."""
    model = fit(vectors)
    error = identity_error(vectors, model)
    shares = F.array(*[F.lit(x) for x in model.explained]) if len(model.values) else F.array().cast("array<double>")
    cells = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return cells.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, "k").alias("explained"), F.lit(error).alias("identity_error"))
