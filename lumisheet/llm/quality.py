"""Quality of documents by a convolutional network over bytes, in NumPy.

A byte has a learned vector; a filter reads a window of ``width`` bytes, and windows start ``stride`` bytes apart. A text is
cut into chunks that overlap, which cover all of its bytes. Three pools of each filter are taken over the whole text: its
largest response, and its largest and its smallest mean over a strip (``2 span`` windows, half of which it shares with the
next); the means tell a passage of repeated or foreign matter in an otherwise plain text. One hidden layer makes them
a probability.

Learning takes at most ``SAMPLE`` labels, the first by a hash of the id, half of each kind, and of a text at most ``PIECES``
pieces of ``PIECE`` bytes, evenly spaced from its start to its end: at most SAMPLE * PIECES * PIECE bytes (32 MB) go
to one task, which fits the network by Adam; gradients flow through the responses and strips that were pooled. Counts of
labels, which set the odds, are taken over all of them. Scoring reads whole texts in one pass without a shuffle; a task
holds an Arrow batch and one block of windows, and what is shared is the network, some ten thousand numbers.

Defined results: null and empty texts are scored as a window of zeros; ids without labels, null labels, labels other
than 0 and 1 and labels without a document teach nothing; an id with several labels teaches each, an id with several texts
the one of least hash; without labels all scores are 0.5, with labels of one kind all are that kind's; repeated rows get a
score each; rows without id are not held out; an empty table gives an empty result; other columns come along (``scored``)
or are ignored (``digest``).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDS, HELD_OUT = 3, 1
SAMPLE, PIECES, PIECE = 2048, 8, 2048
#: Bytes of a chunk, and windows computed at once.
CHUNK, BLOCK = 1 << 16, 1 << 14


@dataclass
class Network:
    """Weights by name; ``constant`` takes the place of the network where there was nothing to tell apart."""

    width: int = 16
    stride: int = 4
    span: int = 32
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    constant: float | None = None


def _start(width: int, vector: int, filters: int, hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    draw = lambda scale, *shape: (rng.normal(size=shape) * scale).astype(np.float32)
    return {
        "bytes": draw(0.5, 256, vector), "filters": draw((2 / (width * vector)) ** 0.5, width * vector, filters), "bias": np.zeros(filters, np.float32),
        "in": draw(filters**-0.5, 3 * filters, hidden), "in_bias": np.zeros(hidden, np.float32), "out": draw(hidden**-0.5, hidden), "out_bias": np.zeros(1, np.float32),
    }


def chunks(size: int, width: int, stride: int, span: int, chunk: int) -> Iterator[tuple[int, int, int]]:
    """Ranges of bytes that hold the windows of a text of ``size`` bytes, and how many they are; each starts with the last span of the one before."""
    windows = max(1, -(-(size - width) // stride) + 1)
    each = max(2, chunk // (stride * span)) * span
    first = 0
    while True:
        n = min(each, windows - first)
        yield first * stride, min(size, (first + n - 1) * stride + width), n
        if first + n == windows:
            return
        first += n - span


def _windows(vectors: np.ndarray, width: int, stride: int, count: int) -> np.ndarray:
    """``count`` windows over the vectors of bytes, as rows without a copy."""
    item, cols = vectors.itemsize, vectors.shape[1]
    return np.lib.stride_tricks.as_strided(vectors, (count, width * cols), (stride * cols * item, item), writeable=False)


def _layout(parts: Sequence[tuple[np.ndarray, int]], width: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Chunks one after the other, filled up with zeros, and the first window of each."""
    rooms = [(n - 1) + -(-width // stride) for _, n in parts]
    starts = np.concatenate(([0], np.cumsum(rooms)))
    out = np.zeros(int(starts[-1]) * stride + width, np.uint8)
    for (data, _), at in zip(parts, starts, strict=False):
        out[at * stride : at * stride + len(data)] = data
    return out, starts[:-1]


def _strips(starts: np.ndarray, sizes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of spans next to each other, (first window, end), and the part of each; a part of one span is a pair of its own."""
    pairs = np.maximum(1, -(-sizes // span) - 1)
    owner = np.repeat(np.arange(len(sizes)), pairs)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    return starts[owner] + k * span, starts[owner] + np.minimum((k + 2) * span, sizes[owner]), owner


def _responses(net: Network, parts: Sequence[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each filter over each chunk: its largest response, and its largest and smallest mean over a strip."""
    w = net.weights
    data, starts = _layout(parts, net.width, net.stride)
    sizes = np.array([n for _, n in parts])
    vectors = w["bytes"][data]
    h = _windows(vectors, net.width, net.stride, int(starts[-1] + sizes[-1])) @ w["filters"] + w["bias"]
    np.maximum(h, 0, out=h)
    a, b, owner = _strips(starts, sizes, net.span)
    sums = np.concatenate((np.zeros((1, h.shape[1])), np.cumsum(h, axis=0, dtype=float)))
    means = ((sums[b] - sums[a]) / (b - a)[:, None]).astype(np.float32)
    cuts = np.stack((starts, starts + sizes), axis=1).ravel()[:-1]  # the last part ends with the responses
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    return np.maximum.reduceat(h, cuts)[::2], np.maximum.reduceat(means, first), np.minimum.reduceat(means, first)


def pooled(net: Network, texts: Sequence[np.ndarray], chunk: int = CHUNK, block: int = BLOCK) -> np.ndarray:
    """Of each text: largest responses, and largest and smallest means of a strip, side by side."""
    f = len(net.weights["bias"])
    out = np.zeros((3, len(texts), f), np.float32)
    out[2] = np.inf
    parts, owners, held = [], [], 0

    def take() -> None:
        for k, (pool, got) in enumerate(zip((np.maximum, np.maximum, np.minimum), _responses(net, parts), strict=True)):
            pool.at(out[k], owners, got)
        parts.clear()
        owners.clear()

    for i, text in enumerate(texts):
        for a, b, n in chunks(len(text), net.width, net.stride, net.span, chunk):
            if parts and held + n > block:
                take()
                held = 0
            parts.append((text[a:b], n))
            owners.append(i)
            held += n
    if parts:
        take()
    return np.concatenate(out, axis=1)


def _probability(net: Network, features: np.ndarray) -> np.ndarray:
    w = net.weights
    z = np.maximum(features @ w["in"] + w["in_bias"], 0) @ w["out"] + w["out_bias"]
    return 1 / (1 + np.exp(-np.clip(z.astype(float), -60, 60)))


def scores(net: Network, texts: Sequence[np.ndarray]) -> np.ndarray:
    """The probability of label 1 for each text, given as bytes."""
    if net.constant is not None or not len(texts):
        return np.full(len(texts), net.constant or 0.0)
    return _probability(net, pooled(net, texts))


def _gradients(net: Network, texts: list[np.ndarray], labels: np.ndarray, drop: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the logistic loss over a few short texts."""
    w, width, stride = net.weights, net.width, net.stride
    parts = [(t, next(chunks(len(t), width, stride, net.span, 1 << 40))[2]) for t in texts]
    data, starts = _layout(parts, width, stride)
    sizes = np.array([n for _, n in parts])
    rows = _windows(w["bytes"][data], width, stride, int(starts[-1] + sizes[-1]))
    h = np.maximum(rows @ w["filters"] + w["bias"], 0)
    f, every = h.shape[1], np.arange(h.shape[1])
    a, b, owner = _strips(starts, sizes, net.span)
    sums = np.concatenate((np.zeros((1, f)), np.cumsum(h, axis=0, dtype=float)))
    means = (sums[b] - sums[a]) / (b - a)[:, None]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    at = np.array([s + h[s : s + n].argmax(axis=0) for s, n in zip(starts, sizes, strict=True)])
    high = np.array([p + means[p:q].argmax(axis=0) for p, q in zip(cuts, cuts[1:], strict=False)])
    low = np.array([p + means[p:q].argmin(axis=0) for p, q in zip(cuts, cuts[1:], strict=False)])
    x = np.concatenate((h[at, every], means[high, every], means[low, every]), axis=1).astype(np.float32) * drop
    z = x @ w["in"] + w["in_bias"]
    r = np.maximum(z, 0)
    p = 1 / (1 + np.exp(-np.clip(r @ w["out"] + w["out_bias"], -60, 60)))
    dz = ((p - labels) / len(texts)).astype(np.float32)
    da = np.outer(dz, w["out"]) * (z > 0)
    dx = (da @ w["in"].T) * drop
    g = {"out": r.T @ dz, "out_bias": dz.sum(keepdims=True), "in": x.T @ da, "in_bias": da.sum(axis=0)}
    steps = np.zeros((len(h) + 1, f))  # what a strip gets goes to each of its windows
    for where, part in ((high, dx[:, f : 2 * f]), (low, dx[:, 2 * f :])):
        share = part / (b - a)[where]
        np.add.at(steps, (a[where], every), share)
        np.add.at(steps, (b[where], every), -share)
    dh = np.cumsum(steps, axis=0)[:-1].astype(np.float32)
    np.add.at(dh, (at, every), dx[:, :f])
    dh *= h > 0
    g["bias"] = dh.sum(axis=0)
    g["filters"] = rows.T @ dh
    hot = dh.any(axis=1)
    back = (dh[hot] @ w["filters"].T).reshape(int(hot.sum()) * width, -1)  # what each byte of each window gets
    codes = data[(np.flatnonzero(hot) * stride)[:, None] + np.arange(width)].ravel()
    g["bytes"] = np.stack([np.bincount(codes, back[:, k], 256) for k in range(back.shape[1])], axis=1).astype(np.float32)
    return g


def learn(texts: Sequence[np.ndarray], labels: Sequence[int], *, width: int = 16, stride: int = 4, span: int = 32, vector: int = 6, filters: int = 24, hidden: int = 16, steps: int = 600, batch: int = 24, rate: float = 8e-3, seed: int = 7, odds: float | None = None) -> Network:
    """A network fitted to texts (bytes) and their labels, 0 or 1.

    Batches hold as many of each label; the scores are then set to ``odds``, how often label 1 stands for one label 0.
    """
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return Network(width, stride, span, constant=float(y[0]) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    net = Network(width, stride, span, _start(width, vector, filters, hidden, rng))
    kinds = [np.flatnonzero(y == k) for k in (0, 1)]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.weights.items()}
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(kind, batch // 2) for kind in kinds])
        drop = (rng.random((len(pick), 3 * filters)) < 0.9).astype(np.float32) / np.float32(0.9)
        g = _gradients(net, [texts[i] for i in pick], y[pick], drop)
        now = rate * (1 - step / (steps + 1)) ** 0.5
        for k, v in net.weights.items():
            m, s = moments[k]
            m *= 0.9
            m += 0.1 * g[k]
            s *= 0.99
            s += 0.01 * g[k] ** 2
            v -= (now * (m / (1 - 0.9**step) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7) + 1e-3 * v)).astype(np.float32)
    net.weights["out_bias"] += np.float32(np.log(odds or y.sum() / (len(y) - y.sum())))
    return net


def _fold(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % FOLDS


def _pieces(text: Column) -> Column:
    """A text's bytes; of a long one ``PIECES`` pieces from its start to its end."""
    data, size = text.cast("binary"), F.octet_length(text)
    spread = F.concat(*[F.substring(data, ((size - PIECE) * F.lit(i) / (PIECES - 1)).cast("int") + 1, F.lit(PIECE)) for i in range(PIECES)])
    return F.when(size <= PIECES * PIECE, data).otherwise(spread)


def _learner(odds: float | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)), key=lambda r: r[:3])
        net = learn([np.frombuffer(r[3], np.uint8) for r in rows], [r[2] for r in rows], odds=odds)
        yield pa.record_batch([pa.array([pickle.dumps(net)], pa.binary())], ["net"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """A network from the labels (``doc_id``, ``quality``) of documents that are not held out."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y"), F.xxhash64("doc_id").alias("h")).where(F.col("y").isin(0, 1) & (_fold(F.col("doc_id")) != HELD_OUT))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows at most
    if len(counts) < 2:
        return Network(constant=float(next(iter(counts), 0.5)))
    first = [known.where(F.col("y") == k).orderBy("h", "doc_id").limit(sample // 2) for k in (0, 1)]
    picked = F.broadcast(first[0].unionByName(first[1]).distinct())  # ``sample`` rows
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(picked, "doc_id").groupBy("h", "doc_id", "y").agg(F.min_by(_pieces(F.col("text")), F.xxhash64("text")).alias("bytes"))
    found = texts.repartition(1).mapInArrow(_learner(counts[1] / counts[0]), "net binary").collect()
    return pickle.loads(found[0].net) if found else Network(constant=0.5)


def _bytes_of(texts: pa.Array) -> list[np.ndarray]:
    """The bytes of each string of a column, without a copy."""
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return [data[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


def score(net: Network, text: Column) -> Column:
    """The probability of label 1 of each text."""

    @F.arrow_udf(T.DoubleType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(scores(net, _bytes_of(texts.fill_null(""))), pa.float64())

    return run(text)


def scored(docs: DataFrame, net: Network, into: str = "score") -> DataFrame:
    """``docs`` with the score of each text; a column of that name is replaced."""
    return docs.withColumn(into, score(net, F.col("text")))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a network that has not seen the labels of those held out."""
    told = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return told.select("doc_id", F.coalesce(_fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
