"""Exact repeats of 100 bytes and more, removed with a distributed, sparse suffix array.

Every 100-byte string is represented by the suffix at its anchor: among the 24-byte grams inside it,
the leftmost with the least hash. Equal strings have equal anchors at equal places, so only suffixes
at anchors (about one in 35) need to be looked at. A suffix stands for the run of strings that share its
anchor; the bytes of these strings are its context.

1. Anchors are range-partitioned by gram, then by a 128-bit digest of the context, document and place.
   A context whose digest stands earlier is a repeat as a whole. First contexts whose gram also has
   other contexts, and those of grams at a bucket's edge, stay open.
2. The suffixes of open contexts (up to 100 bytes from the anchor on, and the bytes before it) are
   range-partitioned by these bytes with splitters that Spark samples. A bucket sorts them by a multikey
   sort whose characters are words of eight bytes (a word is read only where those before it tie), once
   forwards and once by the bytes before the anchor, read backwards. Common prefixes of neighbours in the
   two orders give the classes of equal strings; all but the first of a class are repeats.
3. Strings whose bytes from the anchor on lead to the edge of a bucket may stand in other buckets as well. Contexts with
   such strings are range-partitioned once more, by gram and the bytes before the anchor, and of their strings those stay
   whose bytes before it stand there twice. The first of each class in a bucket, at most one row of a string
   and bucket, meet in a window by their bytes.
4. Each document loses the bytes that its repeats cover.

Scale: a hot passage is no hot key, as splitters cut through ties, and a hot string is one row a bucket
before it meets itself. A bucket has about ``bucket_rows`` anchors. Copies of a context inside one
slice of a document are settled where they are read, so periodic text makes few rows. Texts are shuffled
twice (to fetch contexts, and in the end). The driver sees counts only.

Defined results: a null or empty text has no bytes; texts shorter than the length keep all; a document
without id keeps all and makes nothing else a repeat; rows of equal id and text are one document and
judged alike; unlike texts under one id are documents of their own, in the order of the XXH64 of the
text; an empty table gives an empty result; very long texts are read in slices of a megabyte that overlap by
a string, and only the last step holds a text whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable

LENGTH = 100
GRAM = 24
SLICE = 1 << 20
#: Contexts travel with up to two hundred bytes each, so a bucket of them takes fewer rows.
CONTEXT_SHARE = 4
_PLACE = np.uint64((1 << 22) - 1)  # room for a place in a slice, below the gram's hash
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _words(buf: bytes) -> np.ndarray:
    """The eight bytes from each place on (little-endian); the buffer is padded by 8."""
    return np.ndarray(len(buf) - 7, "<u8", buf, 0, (1,))


def _leading(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The first four of eight bytes, which sort first and like the bytes, with the upper half of a hash below."""
    lead = words.byteswap() >> np.uint64(32) << np.uint64(32)
    return ((lead | hashes >> np.uint64(32)) ^ np.uint64(1 << 63)).view(np.int64)


def _pieces(keys: list, texts: list[bytes | None], length: int) -> Iterator[list[tuple[tuple, int, bytes]]]:
    """Lists of (key, offset, bytes) of about a slice in all; long texts are cut so that no string is lost."""
    group, size = [], 0
    for key, text in zip(keys, texts, strict=True):
        if text is None or len(text) < length:
            continue
        for a in range(0, len(text) - length + 1, SLICE):
            part = text[a : a + SLICE + length - 1]
            group.append((key, a, part))
            size += len(part)
            if size >= SLICE:
                yield group
                group, size = [], 0
    if group:
        yield group


def anchors(group: list[tuple[tuple, int, bytes]], length: int = LENGTH) -> dict[str, np.ndarray]:
    """Runs of strings that share their anchor: ``gram``, digest of the context (``c1``, ``c2``), ``of`` (index of the
    piece), ``place`` of the first string in its document, number ``n`` of strings, bytes ``ahead`` of the anchor."""
    buf = b"".join(p for _, _, p in group) + bytes(GRAM + 8)
    sizes = np.array([len(p) for _, _, p in group])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    total = int(ends[-1])
    u = _words(buf)
    x = u[:total] * _MIX[0]
    for k in range(1, GRAM // 8):
        x ^= x >> np.uint64(31)
        x += u[8 * k : 8 * k + total]
        x *= _MIX[k % 3]
    x ^= x >> np.uint64(32)
    x *= _MIX[1]
    width = length - GRAM + 1
    blocks = -(-total // width) + 1
    key = np.full(blocks * width, ~np.uint64(0))
    key[:total] = x & ~_PLACE | np.arange(total, dtype=np.uint64)
    table = key.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:total], ahead[width - 1 : width - 1 + total])
    whole = np.ones(total, bool)
    whole[(ends[:, None] - np.arange(1, length)).ravel()] = False  # strings that would leave their document
    at = np.flatnonzero(whole)
    anchor = (least[at] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))))
    last = np.append(first[1:], len(at)) - 1
    lo, n, p = at[first], at[last] - at[first] + 1, anchor[first]
    h = xxhash.xxh3_128_digest
    shape = p - lo << 8 | n
    digest = np.frombuffer(b"".join(h(buf[a:b], s) for a, b, s in zip(lo.tolist(), (lo + n + length - 1).tolist(), shape.tolist(), strict=True)), np.int64).reshape(-1, 2)
    of = np.searchsorted(starts, lo, side="right") - 1
    place = np.array([a for _, a, _ in group], np.int64)[of] + lo - starts[of]
    return {"gram": _leading(u[p], x[p]), "c1": digest[:, 0], "c2": digest[:, 1], "of": of, "place": place, "n": n, "ahead": p - lo}


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Order of rows by several keys; a key sorts only runs of rows that tie in all keys before it."""
    order = np.argsort(keys[0], kind="stable")
    tied = np.zeros(len(order), np.int64)  # number of the run of ties that a place belongs to
    current = keys[0][order]
    for key in keys[1:]:
        fresh = np.concatenate(([True], (current[1:] != current[:-1]) | (tied[1:] != tied[:-1])))
        tied = np.cumsum(fresh) - 1
        size = np.bincount(tied)
        open_ = np.flatnonzero(size[tied] > 1)
        if not len(open_):
            break
        sub = np.lexsort((key[order[open_]], tied[open_]))
        order[open_] = order[open_][sub]
        current = key[order]
    return order


def _same(columns: list[np.ndarray]) -> np.ndarray:
    """Whether a row equals the one before it."""
    out = np.zeros(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    return out


def _joined_runs(owner: list[np.ndarray], place: np.ndarray, n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Runs of strings of an owner, one for each stretch of adjacent ones: owners, and place << 31 | count."""
    order = np.lexsort((place, *owner[::-1]))
    owner, place, n = [o[order] for o in owner], place[order], n[order]
    follows = _same(owner)
    follows[1:] &= place[1:] == place[:-1] + n[:-1]
    start = np.flatnonzero(~follows)
    count = np.add.reduceat(n, start) if len(start) else n
    return [o[start] for o in owner], place[start] << 31 | count


def repeated_contexts(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """(id, h, gone, open): for each document the runs of strings (place << 31 | count) that repeat as a whole, and the
    open ones (place << 16 | count << 8 | bytes ahead of the anchor)."""
    names = ["gram", "c1", "c2", "id", "h", "run"]
    schema = ", ".join(f"{c} long" for c in names) + ", known boolean"

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for group in _pieces(keys, batch.column(2).cast(pa.binary()).to_pylist(), length):
                got = anchors(group, length)
                of, place, n = got["of"], got["place"], got["n"]
                order = np.lexsort((place, got["c2"], got["c1"], of))
                again = np.zeros(len(of), bool)  # a context that the same slice of the document has before
                again[order] = _same([got[c][order] for c in ("of", "c1", "c2")])
                (known_of,), known = _joined_runs([of[again]], place[again], n[again])
                left = ~again
                run = np.concatenate((place[left] << 16 | n[left] << 8 | got["ahead"][left], known))
                of = np.concatenate((of[left], known_of))
                key = np.array([k for k, _, _ in group], np.int64).reshape(-1, 2)[of]
                fill = lambda c: np.concatenate((got[c][left], key[np.count_nonzero(left) :, 0]))  # noqa: E731  any value that spreads
                flag = np.arange(len(run)) >= np.count_nonzero(left)
                columns = [fill("gram"), fill("c1"), fill("c2"), key[:, 0], key[:, 1], run, flag]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*names, "known"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        columns = [c.to_numpy() for c in pa.Table.from_batches([first, *batches]).columns]
        known = columns.pop()
        done = [columns[3][known], columns[4][known], columns[5][known]]
        columns = [c[~known] for c in columns]
        order = multikey_order(columns)
        gram, c1, c2, key, h, run = (c[order] for c in columns)
        in_gram = _same([gram])
        repeat = in_gram & _same([c1, c2])
        of = np.cumsum(~in_gram) - 1
        contexts = np.bincount(of, ~repeat)
        open_ = ~repeat & ((contexts[of] > 1) | (of == 0) | (of == of[-1:]))
        owner, gone = _joined_runs([key[repeat], h[repeat]], run[repeat] >> 16, run[repeat] >> 8 & 0xFF)
        out = [np.concatenate(x) for x in ((owner[0], done[0], key[open_]), (owner[1], done[1], h[open_]), (gone, done[2], run[open_]))]
        flag = np.arange(len(out[0])) < len(gone) + len(done[0])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*out, flag)], names=["id", "h", "run", "gone"])

    rows = docs.select("id", "h", "text").mapInArrow(suffixes, schema)
    found = rows.repartitionByRange(buckets, *names).mapInArrow(compare, "id long, h long, run long, gone boolean")
    pick = lambda gone: F.collect_list(F.when(F.col("gone") == gone, F.col("run")))
    return found.groupBy("id", "h").agg(pick(True).alias("gone"), pick(False).alias("open"))


def _matrix(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Binary values as rows of ``width`` bytes, padded with zeros, and their sizes."""
    data = b"".join(column.to_pylist())
    size = pa.compute.binary_length(column).to_numpy().astype(np.int64)
    end = np.cumsum(size)
    out = np.zeros((len(size), width), np.uint8)
    out.reshape(-1)[np.repeat(np.arange(len(size)) * width - end + size, size) + np.arange(len(data))] = np.frombuffer(data, np.uint8)
    return out, size


def _common(rows: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Bytes that rows have in common with another row, or each with its own."""
    differ = rows != other
    return np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])


def _ordered(rows: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of bytes (those of equal ``before`` together), and what each has in common with its neighbour: bytes, or -1."""
    keys = list(rows.view(">u8").astype(np.uint64).T)
    order = multikey_order(keys if before is None else [before, *keys])
    common = np.full(len(order), -1, np.int64)
    for a in range(1, len(order), 1 << 16):
        part = rows[order[a - 1 : a + (1 << 16)]]
        common[a : a + (1 << 16)] = _common(part[1:], part[:-1])
    if before is not None:
        common[1:][before[order[1:]] != before[order[:-1]]] = -1
    return order, common


def string_classes(suffix: np.ndarray, size: np.ndarray, ahead: np.ndarray, room: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of contexts in order of their documents and places: for each distance to the anchor the rows that have a string
    there, and whether an equal one stands in a row before. ``suffix`` and ``ahead`` are padded bytes, the latter backwards."""
    forward, common = _ordered(suffix)
    group = np.zeros(len(size), np.int64)
    group[forward] = np.cumsum(common < GRAM)
    backward, shared = _ordered(ahead, group)
    left, right = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    least = length - size
    for o in range(int(least.min(initial=0)), int(room.max(initial=-1)) + 1):
        own = np.flatnonzero((least <= o) & (o <= room))
        if not len(own):
            continue
        right[forward] = np.cumsum(common < length - o)
        left[backward] = np.cumsum(shared < o)
        _, first = np.unique(right[own] * (len(size) + 1) + left[own], return_index=True)
        again = np.ones(len(own), bool)
        again[first] = False
        yield o, own, again


def repeated_strings(docs: DataFrame, runs: DataFrame, length: int, buckets: int) -> DataFrame:
    """(id, h, single): for each document the strings in its open runs that stand earlier (place << 31 | count)."""
    schema = "suffix binary, ahead binary, id long, h long, place long"
    names = ["suffix", "ahead", "id", "h", "place"]
    widths = -(-length // 8) * 8, -(-(length - GRAM) // 8) * 8

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for key, h, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3), strict=True):
                text = text.as_py()
                for run in own.values.to_pylist():
                    lo = run >> 16
                    p = lo + (run & 0xFF)
                    out.append((text[p : lo + (run >> 8 & 0xFF) + length - 1], text[lo:p][::-1], key, h, p))
                    if len(out) == 8192:
                        yield _batch(out)
                        out = []
        if out:
            yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        rows = pa.Table.from_batches([first, *batches])
        key, h, place = (rows.column(c).to_numpy() for c in names[2:])
        order = np.lexsort((place, h, key))
        order = order[~_same([key[order], h[order], place[order]])]
        key, h, place = key[order], h[order], place[order]
        (suffix, size), (ahead, room) = (_matrix(rows.column(c).take(pa.array(order)), w) for c, w in zip(names[:2], widths, strict=True))
        # a string of r bytes from its anchor on may stand in another bucket only if they lead to this bucket's edge
        by_bytes = np.lexsort(suffix.view(">u8").T[::-1])
        reach = np.maximum(_common(suffix, suffix[by_bytes[0]]), _common(suffix, suffix[by_bytes[-1]]))
        out: list[list[np.ndarray]] = []
        asks = np.zeros((len(key), length - GRAM + 1), bool)
        for o, own, again in string_classes(suffix, size, ahead, room, length):
            gone = own[again]
            out.append([key[gone], h[gone], place[gone] - o])
            asks[own[~again & (reach[own] >= length - o)], o] = True
        edge = np.flatnonzero(asks.any(axis=1))
        at = pa.array(order[edge])
        masks = pa.array([m.tobytes() for m in np.packbits(asks[edge], axis=1)], pa.binary())
        yield pa.RecordBatch.from_arrays([*(rows.column(c).take(at).combine_chunks() for c in names), masks], names=[*names, "ask"])
        key, h, start = (np.concatenate(x) for x in zip(*out, strict=True))
        (key, h), run = _joined_runs([key, h], start, np.ones(len(start), np.int64))
        none = pa.nulls(len(run), pa.binary())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(key), pa.array(h), pa.array(run), none], names=[*names, "ask"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the strings asked for, those whose bytes before the anchor stand before the same gram elsewhere, or may."""
        first = next(batches, None)
        if first is None:
            return
        rows = pa.Table.from_batches([first, *batches])
        key, h, place = (rows.column(c).to_numpy() for c in names[2:])
        (suffix, _), (ahead, room) = (_matrix(rows.column(c), w) for c, w in zip(names[:2], widths, strict=True))
        asks = np.unpackbits(_matrix(rows.column("ask"), -(-(length - GRAM + 1) // 8))[0], axis=1).view(bool)
        by_gram, common = _ordered(suffix[:, :GRAM].copy())
        group = np.zeros(len(key), np.int64)
        group[by_gram] = np.cumsum(common < GRAM)
        order, common = _ordered(ahead, group)
        both = np.maximum(common, np.append(common[1:], -1))
        both[[0, -1]] = length  # of neighbours in other buckets nothing is known
        most = np.zeros(len(key), np.int64)
        most[order] = both
        for o in range(asks.shape[1]):
            ask = np.flatnonzero(asks[:, o] & (most >= o)) if o <= length - GRAM else []
            for part in np.array_split(ask, -(-len(ask) // 8192)) if len(ask) else ():
                strings = np.concatenate((ahead[part, :o][:, ::-1], suffix[part, : length - o]), axis=1)
                offsets = pa.py_buffer(np.arange(0, (len(part) + 1) * length, length, dtype=np.int32))
                binary = pa.Array.from_buffers(pa.binary(), len(part), [None, offsets, pa.py_buffer(np.ascontiguousarray(strings))])
                yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(h[part]), pa.array(place[part] - o), binary], names=["id", "h", "run", "string"])

    rows = docs.join(runs.where(F.size("open") > 0).select("id", "h", "open"), ["id", "h"]).select("id", "h", "text", "open").mapInArrow(contexts, schema)
    found = durable(rows.repartitionByRange(buckets, *names).mapInArrow(compare, schema + ", ask binary"))
    edges = found.where("ask IS NOT NULL").repartitionByRange(buckets, F.substring("suffix", 1, GRAM), "ahead", "id", "h", "place")
    first = Window.partitionBy("string").orderBy("id", "h", "run")
    across = edges.mapInArrow(shared, "id long, h long, run long, string binary").withColumn("k", F.row_number().over(first)).where("k > 1")
    across = across.select("id", "h", (F.shiftleft("run", 31) + 1).alias("run"))
    return found.where("ask IS NULL").select("id", "h", F.col("place").alias("run")).union(across).groupBy("id", "h").agg(F.collect_list("run").alias("single"))


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``docs`` (id, text) with ``h``, which tells unlike texts of an id apart; one row of each (id, h); and the bytes of all texts."""
    h = F.xxhash64("text")
    per = docs.where("id IS NOT NULL").groupBy("id", h.alias("h")).agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("bytes"))
    of_id = per.groupBy("id").agg(F.count("*").alias("texts"), F.max("n").alias("n"), F.sum("bytes").alias("bytes"))
    texts, n, size = of_id.agg(F.max("texts"), F.max("n"), F.sum("bytes")).first()
    tag: Column = h if (texts or 0) > 1 else F.lit(0).cast("long")
    whole = docs.withColumn("h", tag)
    once = whole.where("id IS NOT NULL")
    return whole, once.dropDuplicates(["id", "h"]) if (n or 0) > 1 else once, size or 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, bucket_rows: int = 400_000) -> DataFrame:
    """One row per document: id, ``kept`` (its bytes left), ``n_bytes``, ``n_removed``, ``n_spans``."""
    if not GRAM + 1 <= length <= GRAM + 254:
        raise ValueError(f"length must lie between {GRAM + 1} and {GRAM + 254}")
    spark = docs.sparkSession
    base, once, size = _keyed(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = durable(repeated_contexts(once, length, max(least, math.ceil(2 * size / (length - GRAM + 2) / bucket_rows))))
    open_ = runs.select(F.sum(F.size("open"))).first()[0] or 0
    single = repeated_strings(once, runs, length, max(least, math.ceil(CONTEXT_SHARE * open_ / bucket_rows)))
    cuts = runs.select("id", "h", "gone").join(single, ["id", "h"], "full")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            kept, sizes, removed, spans = [], [], [], []
            for i, text in enumerate(texts):
                text = text.as_py() or b""
                left, n = _cut(text, [c[i].values.to_numpy() for c in batch.columns[2:] if c[i].is_valid], length)
                kept.append(left)
                sizes.append(len(text))
                removed.append(len(text) - len(left))
                spans.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans))], names=["id", "kept", "n_bytes", "n_removed", "n_spans"])

    whole = base.join(cuts, ["id", "h"], "left").select("id", "text", "gone", "single")
    return whole.mapInArrow(apply, "id long, kept binary, n_bytes long, n_removed long, n_spans long").withColumnRenamed("id", id_col)


def _cut(text: bytes, runs: list[np.ndarray], length: int) -> tuple[bytes, int]:
    """The bytes outside all repeats, and the number of maximal runs taken out."""
    run = np.concatenate(runs) if runs else np.zeros(0, np.int64)
    if not len(run):
        return text, 0
    start = run >> 31
    end = start + (run & 0x7FFFFFFF) + length - 1
    change = np.bincount(start, minlength=len(text) + 1) - np.bincount(end, minlength=len(text) + 1)
    out = np.cumsum(change[:-1]) > 0
    return np.frombuffer(text, np.uint8)[~out].tobytes(), int(np.count_nonzero(np.diff(np.concatenate(([0], out.astype(np.int8)))) == 1))


def digest(docs: DataFrame) -> DataFrame:
    """The report of the query: one row per document."""
    left = remove_repeats(docs.select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute(docs: list[tuple[int, bytes]], length: int = LENGTH) -> dict[tuple[int, bytes], tuple[int, int, str]]:
    """The result by a table of all strings, for tests: by id and text (n_removed, n_spans, sha256 of what is kept)."""
    seen: set[bytes] = set()
    out = {}
    for key, text in sorted(set(docs), key=lambda d: (d[0], np.uint64(xxhash.xxh64_intdigest(d[1], 42)).astype(np.int64))):
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            if (s := text[i : i + length]) in seen:
                gone[i : i + length] = b"\x01" * length
            seen.add(s)
        left = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        out[key, text] = (sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(left).hexdigest())
    return out


#: DuckDB: all strings of 100 bytes, as hexadecimal digits.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, i, md5(x[2 * i + 1 : 2 * i + 200]) AS k FROM (SELECT doc_id, x, unnest(range(len(x) // 2 - 99)) AS i FROM d WHERE len(x) >= 200)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM s) WHERE n > 1),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM r),
n AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
spans AS (SELECT doc_id, span, min(i) AS a, max(i) + 100 AS b FROM n GROUP BY doc_id, span),
cuts AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, list(struct_pack(a := a, b := b) ORDER BY a) AS l FROM spans GROUP BY doc_id),
gaps AS (SELECT doc_id, l, unnest(range(len(l) + 1)) AS j FROM cuts),
kept AS (SELECT doc_id, string_agg(CASE WHEN j = len(l) THEN substring(x, CAST(2 * l[j].b + 1 AS BIGINT)) ELSE x[CASE WHEN j = 0 THEN 1 ELSE 2 * l[j].b + 1 END : 2 * l[j + 1].a] END, '' ORDER BY j) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM d LEFT JOIN cuts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
