"""SimHash near-duplicates, found exactly with vantage-point trees over Hamming distance.

Fingerprints that differ in at most 4 of 64 bits differ in at most 1, 1 or 0 bits of some of three lanes of
21, 21 and 22 bits (else in 2 + 2 + 1 at least). Each lane has a vantage-point tree over Hamming distance
within the lane: a node sends distances up to its cut inside and the others outside, and by the triangle
inequality a pair within the lane's radius can be parted only if the one outside lies within the radius of the
cut, so those go inside as well. The leaves are the shards; a pair meets in a shard of some tree. A shard
is searched with trees of the same kind, over three lanes of the bits that are left, down to leaves in which
whole fingerprints are compared.

Why lanes and not the whole 64 bits: distances between unrelated fingerprints crowd round 32 +- 4, so
a radius of 4 overlaps nearly every boundary and a tree over all bits prunes next to nothing.

Scale: equal fingerprints are one row. The trees are fitted on ``sample_rows`` fingerprints at most, chosen by hash,
and have ``leaves`` leaves a lane (more only where a shard would hold over ``shard_rows`` fingerprints before copies),
so the driver's work and the rows that a fingerprint makes do not grow with the corpus. The trees set the cost,
never the result. A shard with more rows than ``block_rows`` is cut into blocks that are compared pair by
pair of blocks in tasks of their own, so no group is ever in one task. A task emits a spanning forest of
what it linked, never all pairs. A class of equal fingerprints carries its least id, and the least (id, fingerprint)
spreads over the links, so no component is gathered.

Defined results: null and empty texts have no words and fingerprint zero, which links like any other;
repeated rows and ties share a fingerprint and a component; rows without id link, but name no component while
another does; unlike texts under one id are rows of their own; very long texts are read whole; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, durable

MAX_BITS = 4
LANES = 3
SHINGLE = 4
#: Rows of a shard that are compared without a tree, and sampled fingerprints that a tree inside a shard is fitted on.
LEAF_ROWS, FIT_ROWS = 256, 1 << 16


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """SimHash of the word shingles: a bit is set if it is in over half of the XXH64 (seed 42) values."""
    ws = (text or b"").lower().split()  # bytes: A-Z only, and white space is 0x20 and 0x09-0x0D
    if not ws:
        return 0
    joined = b" ".join(ws)
    n = max(1, len(ws) - size + 1)
    starts = np.zeros(len(ws) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in ws], out=starts[1:])
    ends = starts[min(size, len(ws)) : min(size, len(ws)) + n] - 1
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends.tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        part = hashes[i : i + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * ones > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """``docs`` without the text, with ``fp``: the fingerprint as a signed 64-bit integer."""
    rest = [f for f in docs.schema.fields if f.name not in (text_col, "fp")]
    schema = T.StructType([*rest, T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), size) for t in texts), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps)], names=schema.fieldNames())

    return docs.select(*[f.name for f in rest], text_col).mapInArrow(run, schema)


def lanes(bits: list[int], max_bits: int) -> list[tuple[np.uint64, int]]:
    """Masks and radii of lanes over these bit positions: what differs in ``max_bits`` at most is within some radius."""
    n = min(LANES, max_bits + 1)
    spare = max_bits + 1 - n
    edges = [len(bits) * k // n for k in range(n + 1)]
    return [(np.uint64(sum(1 << b for b in bits[edges[k] : edges[k + 1]])), spare // n + (k < spare % n)) for k in range(n)]


class VantageTree:
    """A vantage-point tree over the bits of a mask, fitted on a sample, as arrays: vantage, cut, children (a leaf: its number, negative)."""

    def __init__(self, sample: np.ndarray, mask: np.uint64, radius: int, leaf_rows: int, seed: int):
        rng = np.random.default_rng(seed)
        sample = sample & mask
        self.mask, self.radius, self.leaves, self.root = mask, radius, 0, -1
        vantage, cut, inside, outside = [], [], [], []
        work = [(sample, -1, True)]
        while work:
            own, parent, inner = work.pop()
            split = self._split(own, leaf_rows, rng)
            if split is None:
                self.leaves += 1
                here = -self.leaves
            else:
                here = len(vantage)
                v, c, d = split
                vantage.append(v)
                cut.append(c)
                inside.append(0)
                outside.append(0)
                work += [(own[d <= c + radius], here, True), (own[d > c], here, False)]
            if parent < 0:
                self.root = here
            elif inner:
                inside[parent] = here
            else:
                outside[parent] = here
        self.arrays = np.array(vantage, np.uint64), *(np.array(x, np.int64) for x in (cut, inside, outside))

    def _split(self, own: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> tuple[np.uint64, int, np.ndarray] | None:
        """The vantage point and cut whose larger side is smallest; None for a leaf."""
        total = len(own)
        if total <= leaf_rows:
            return None
        best, most = None, 0.9 * total
        for v in rng.choice(own, min(8, total), replace=False):
            d = np.bitwise_count(own ^ v).astype(np.int64)
            upto = np.cumsum(np.bincount(d, minlength=65 + self.radius))
            larger = np.maximum(upto[self.radius :][:65], total - upto[:65])
            c = int(larger.argmin())
            if larger[c] < most:
                best, most = (v, c, d), larger[c]
        return best

    def route(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaves (from 1): each row goes wherever a row outside within the radius of it may look for it."""
        vantage, cut, inside, outside = self.arrays
        row, node = np.arange(len(prints)), np.full(len(prints), self.root)
        rows, leaves = [], []
        while len(row):
            done = node < 0
            rows.append(row[done])
            leaves.append(-node[done])
            row, node = row[~done], node[~done]
            d = np.bitwise_count((prints[row] & self.mask) ^ vantage[node]).astype(np.int64)
            a, b = d <= cut[node] + self.radius, d > cut[node]
            row, node = np.concatenate((row[a], row[b])), np.concatenate((inside[node[a]], outside[node[b]]))
        return np.concatenate(rows or [row]), np.concatenate(leaves or [node])


def _links(x: np.ndarray, side: np.ndarray | None, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``max_bits``, in chunks; with ``side`` only those across the two sides."""
    step = max(1, (1 << 21) // max(1, len(x)))
    for i in range(0, len(x) - 1, step):
        near = np.bitwise_count(x[i : i + step, None] ^ x[None, i:]) <= max_bits
        a, b = np.nonzero(near)
        if len(a):
            a, b = a + i, b + i
            own = a < b if side is None else (a < b) & (side[a] != side[b])
            yield a[own], b[own]


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least index linked to each of n, pairs given in chunks."""
    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root[root] != root).any():
                root = root[root]
    return root


def shard_forest(x: np.ndarray, side: np.ndarray | None, bits: list[int], max_bits: int, leaf_rows: int = LEAF_ROWS) -> np.ndarray:
    """The least index linked to each fingerprint of a shard (directly or by others of the shard), by trees over ``bits``."""
    if len(x) <= 2 * leaf_rows:
        return forest(len(x), _links(x, side, max_bits))
    found = []
    sample = x if len(x) <= FIT_ROWS else np.random.default_rng(len(x)).choice(x, FIT_ROWS, replace=False)
    for mask, radius in lanes(bits, max_bits):
        tree = VantageTree(sample, mask, radius, max(8, leaf_rows * len(sample) // len(x)), 7)
        row, leaf = tree.route(x)
        order = np.argsort(leaf, kind="stable")
        for own in np.split(row[order], np.flatnonzero(np.diff(leaf[order])) + 1):
            own = np.sort(own)
            root = forest(len(own), _links(x[own], None if side is None else side[own], max_bits))
            linked = np.flatnonzero(root != np.arange(len(own)))
            if len(linked):
                found.append((own[root[linked]], own[linked]))
    return forest(len(x), iter([tuple(np.concatenate(c) for c in zip(*found, strict=True))] if found else []))


def near_edges(
    distinct: DataFrame, max_bits: int = MAX_BITS, leaves: int = 256, shard_rows: int = 1 << 18, block_rows: int = 1 << 20, sample_rows: int = FIT_ROWS, leaf_rows: int = LEAF_ROWS, seed: int = 1
) -> DataFrame:
    """Links between distinct fingerprints: of rows (fp, id) the edges (a, b, a_id, b_id) that join exactly what is within ``max_bits``.

    All parameters but ``max_bits`` steer only the cost.
    """
    if not 0 <= max_bits < 64:
        raise ValueError("max_bits must lie between 0 and 63")
    routed = route(distinct, max_bits, leaves, shard_rows, sample_rows, seed)
    # a row for each large leaf of the trees, which are themselves broadcast
    sizes = routed.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > block_rows).select("leaf", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    cut = routed.join(F.broadcast(sizes), "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("k", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # block k meets every block: cells (min, max)
    cells = cut.select("leaf", "fp", "id", "k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j")).select("leaf", F.least("k", "j").alias("lo"), F.greatest("k", "j").alias("hi"), "fp", "id", "k")
    apart = lanes(list(range(64)), max_bits)

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fp", kind="stable")
        fp, key, k = pdf.fp.to_numpy(), pdf.id.to_numpy(), pdf.k.to_numpy()
        mask = int(apart[int(pdf.leaf.iat[0]) % len(apart)][0])
        rest = [b for b in range(64) if not mask >> b & 1]
        root = shard_forest(fp.view(np.uint64), None if pdf.lo.iat[0] == pdf.hi.iat[0] else k, rest or list(range(64)), max_bits, leaf_rows)
        linked = np.flatnonzero(root != np.arange(len(fp)))
        return pd.DataFrame({"a": fp[root[linked]], "b": fp[linked], "a_id": key[root[linked]], "b_id": key[linked]})

    return cells.groupBy("leaf", "lo", "hi").applyInPandas(link, "a long, b long, a_id long, b_id long").distinct()


def route(distinct: DataFrame, max_bits: int, leaves: int, shard_rows: int, sample_rows: int, seed: int) -> DataFrame:
    """(leaf, fp, id): each fingerprint in all shards that it may meet others in."""
    spark = distinct.sparkSession
    n = distinct.count()
    wanted = max(1, min(leaves, -(-n // 1024)), -(-n // shard_rows))
    hashed = F.pmod(F.xxhash64("fp", F.lit(seed)), F.lit(1 << 30))
    thin = distinct.select("fp").where(hashed < int(min(1.0, 0.9 * sample_rows / max(1, n)) * (1 << 30))).limit(sample_rows)
    sample = thin.toPandas().fp.to_numpy(np.int64).view(np.uint64)
    sample = np.sort(sample)
    trees = [VantageTree(sample, mask, radius, max(4, len(sample) // wanted), seed + k) for k, (mask, radius) in enumerate(lanes(list(range(64)), max_bits))]
    shared = spark.sparkContext.broadcast(trees)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for k, tree in enumerate(shared.value):
                row, leaf = tree.route(fps.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array((leaf * len(shared.value) + k).astype(np.int32)), *batch.take(pa.array(row)).columns], names=["leaf", "fp", "id"])

    return distinct.select("fp", "id").mapInArrow(send, "leaf int, fp long, id long")


def near_components(prints: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(fp, head_id, head_fp): of all that is reachable over links the least id, and its fingerprint (the least, if several)."""
    classes = durable(prints.groupBy("fp").agg(F.min(id_col).alias("id")))
    edges = durable(near_edges(classes, **options))
    vertex = lambda fp, key: F.struct(F.col(key).isNull().alias("none"), F.coalesce(key, F.lit(0)).alias("id"), F.col(fp).alias("fp"))  # noqa: E731  rows without id come last
    joined = components(edges.select(vertex("a", "a_id").alias("a"), vertex("b", "b_id").alias("b")))
    linked = joined.select(F.col("id.fp").alias("fp_"), F.when(~F.col("label.none"), F.col("label.id")).alias("to_id"), F.col("label.fp").alias("to_fp"))
    of = classes.join(linked, classes.fp == linked.fp_, "left")
    return of.select("fp", F.when(F.col("to_fp").isNull(), F.col("id")).otherwise(F.col("to_id")).alias("head_id"), F.coalesce("to_fp", "fp").alias("head_fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, ``fp``, ``component_id``, and ``head_fp``, the fingerprint of that document."""
    rest = [c for c in docs.columns if c not in ("fp_", "component_id", "head_fp")]
    prints = durable(fingerprints(docs.select(*rest), text_col))
    heads = near_components(prints, id_col, **options).select(F.col("fp").alias("fp_"), F.col("head_id").alias("component_id"), "head_fp")
    heads = durable(heads)  # so that both sides of the join are dealt anew, and adaptive execution may split a hot fingerprint
    return prints.join(heads, F.col("fp") == F.col("fp_")).drop("fp_")


def keep_first(docs: DataFrame) -> DataFrame:
    """The document with the least id of each component, whole, one row of it.

    Of unlike texts under one id each is judged on its own; where they share a fingerprint, that with the least
    XXH64 stays. Documents without id stay.
    """
    h = F.xxhash64("text")
    found = near_duplicates(docs.where("doc_id IS NOT NULL").select("doc_id", "text", h.alias("h")))
    heads = durable(found.where("doc_id = component_id AND fp = head_fp").groupBy("doc_id", "fp").agg(F.min("h").alias("_h"), F.count("*").alias("_n")).select("doc_id", "_h", "_n"))
    named = docs.select(F.struct(F.lit(True).alias("_"), *[F.col(c) for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), h.alias("_text"))
    kept = named.join(heads, (F.col("_id") == heads.doc_id) & (F.col("_text") == heads._h), "left_semi")
    if heads.where("_n > 1").limit(1).count():
        kept = kept.dropDuplicates(["_id", "_text"])
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns]).union(docs.where("doc_id IS NULL"))


def digest(docs: DataFrame) -> DataFrame:
    """The report of the query: one row per document."""
    return near_duplicates(docs.select("doc_id", "text")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
