"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton of a block of items is built once on the driver and broadcast; tasks stream the
words of their documents through it and track the longest match that ends at each word. A block
holds at most ``max_block_words`` words (a longer item is cut, with an overlap of a window), so what is
broadcast has a fixed bound: the documents pass through a few automata at a time, and what those find is
written before the next. There is no shuffle of documents and no join.

Defined results: a null or empty text has no words and no hits; a null or empty item is ignored; an item without id
is named by the empty string; very long texts are read whole;
repeated documents are judged each on their own, repeated items count once by ``item_id``; an
empty benchmark leaves all documents clean; other columns of either table are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, packed, unpacked

#: A-Z to a-z; every ASCII character that is neither a letter nor a digit to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32 for c in range(256))

WINDOW = 13


def words(text: str | bytes | None) -> list[bytes]:
    """Lower-cased words as UTF-8; all characters beyond ASCII belong to words."""
    if text is None:
        return []
    return (text if isinstance(text, bytes) else text.encode()).translate(_FOLD).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word ids, with the items of each window marked at its state."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.vocab: dict[bytes, int] = {}
        coded = [(item, [self.vocab.setdefault(w, len(self.vocab)) for w in ws]) for item, ws in items if ws]
        self.shortest = min((len(c) for _, c in coded), default=window)
        self.shortest = min(self.shortest, window)
        for _, code in coded:
            last = 0
            for c in code:
                last = self._extend(last, c)
        self.whole: dict[int, set[str]] = {}  # state of a window of full length: items
        self.short: dict[int, list[tuple[int, str]]] = {}  # state of a short item: its length and name
        for item, code in coded:
            size = min(window, len(code))
            state = matched = 0
            for c in code:
                state, matched = self.step(state, matched, c, size)
                if matched == size and len(code) >= window:
                    self.whole.setdefault(state, set()).add(item)
            if len(code) < window:
                self.short.setdefault(state, []).append((size, item))
        self.short_at = [-1] * len(self.link)  # the nearest state up the links that has short items
        if self.short:
            for s in sorted(range(len(self.link)), key=self.length.__getitem__):
                self.short_at[s] = s if s in self.short else self.short_at[self.link[s]] if s else -1

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        cur = self._new(length[last] + 1, {})
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return cur

    def _new(self, length: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, p: int, q: int, c: int) -> int:
        copy = self._new(self.length[p] + 1, dict(self.next[q]))
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def step(self, state: int, matched: int, c: int, cap: int) -> tuple[int, int]:
        """State and length of the longest match that ends at the next word, up to ``cap`` words."""
        nxt, link, length = self.next, self.link, self.length
        while state and c not in nxt[state]:
            state = link[state]
            matched = length[state]
        if c not in nxt[state]:
            return 0, 0
        state, matched = nxt[state][c], matched + 1
        if matched > cap:
            matched = cap
        while length[link[state]] >= matched:  # the state that holds just this length
            state = link[state]
        return state, matched

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans (start, end exclusive) of words inside windows, and the items they come from."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        if len(ws) < self.shortest or not self.vocab:
            return spans, found
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in ws), np.int64, len(ws))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], ids >= 0, [0]))))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):  # runs of known words
            if b - a < self.shortest:
                continue
            state = matched = 0
            for at, c in enumerate(ids[a:b].tolist(), a):
                state, matched = self.step(state, matched, c, self.window)
                longest = 0
                if matched == self.window and (hit := self.whole.get(state)):
                    longest = matched
                    found |= hit
                if self.short and matched:
                    s = self.short_at[state]
                    while s != -1:
                        for n, item in self.short[s]:
                            if n <= matched:
                                longest = max(longest, n)
                                found.add(item)
                        s = self.short_at[self.link[s]] if s else -1
                if longest:
                    start = at + 1 - longest
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, at + 1))
        return spans, found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, max_block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Lists of (item, words), of ``max_block_words`` and a window at most; longer items are cut so that no window is lost."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text")).where("text is not null").distinct()
    block, size, none = [], 0, True
    for r in items.toLocalIterator():
        ws = words(r.text)
        for a in range(0, max(1, len(ws) - window + 1), max_block_words):
            part = ws[a : a + max_block_words + window - 1]
            if block and size + len(part) > max_block_words:
                yield block
                block, size, none = [], 0, False
            block.append((r.item, part))
            size += len(part)
    if block or none:
        yield block


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_block_words: int = 200_000,
    blocks_at_once: int = 4,
) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (word offsets, end exclusive, merged) and ``hit_items`` (sorted).

    A stage holds ``blocks_at_once`` automata; what it finds is written before the next one starts.
    """
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    names = ["n_words", "hit_spans", "hit_items"]
    kept = [c for c in docs.columns if c not in names]
    out = docs.select(*kept)
    sc = docs.sparkSession.sparkContext
    blocks = _blocks(benchmark, item_col, item_text_col, window, max_block_words)
    first = True
    while held := [sc.broadcast(SuffixAutomaton(block, window)) for block in islice(blocks, blocks_at_once)]:
        out = _scan(out if first else durable(out), held, text_col, span, first)
        first = False
    return out


def _scan(docs: DataFrame, automata: list, text_col: str, span: T.ArrayType, first: bool) -> DataFrame:
    base = docs.schema if first else T.StructType(docs.schema.fields[:-3])
    schema = T.StructType([*base.fields, T.StructField("n_words", T.LongType()), T.StructField("hit_spans", span), T.StructField("hit_items", T.ArrayType(T.StringType()))])
    at, width = base.fieldNames().index(text_col), len(base.fields)
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sams = [a.value for a in automata]
        for batch in batches:
            n_words, spans, items = [], [], []
            before = zip(batch.column(width + 1).to_pylist(), batch.column(width + 2).to_pylist(), strict=True) if not first else None
            for text in batch.column(at).cast(pa.binary()):
                ws = words(text.as_py())
                own, found = sams[0].scan(ws)
                for sam in sams[1:]:
                    more, items_ = sam.scan(ws)
                    own, found = _merged(own + more) if more else own, found | items_
                if before is not None:
                    was, had = next(before)
                    own, found = _merged(own + [(x["start"], x["end"]) for x in was]), found | set(had)
                n_words.append(len(ws))
                spans.append([{"start": a, "end": b} for a, b in own])
                items.append(sorted(found))
            columns = [*batch.columns[:width], pa.array(n_words, pa.int64()), pa.array(spans, arrow_span), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, min_share: float = 0.05, **options) -> DataFrame:
    """``benchmark_hits`` with ``n_hit`` and the verdict: some word is hit, and at least ``min_share`` of all words are."""
    hits = benchmark_hits(docs, benchmark, **options)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return hits.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * F.lit(1 / min_share) >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that the rule leaves, with their own columns and whole texts."""
    return unpacked(contaminated(packed(docs, "text"), benchmark, **options).where(~F.col("contaminated")), docs.columns, "text")


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", min_words: int = WINDOW, min_share: float = 0.0, **options) -> DataFrame:
    """Documents whose hit spans are cut from the text where a span has ``min_words`` words, or all where the
    hits reach ``min_share`` of the words (0: never for that reason)."""
    judged = contaminated(packed(docs, text_col), benchmark, text_col=text_col, min_share=min_share or 2.0, **options)
    long_ = F.filter("hit_spans", lambda x: F.col("contaminated") | (x["end"] - x["start"] >= min_words))
    judged = judged.select("_row", long_.alias("cut"), text_col)
    schema = T.StructType([judged.schema["_row"], judged.schema[text_col]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_without(t, [(x["start"], x["end"]) for x in spans]) if spans else t for t, spans in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=schema.fieldNames())

    return unpacked(judged.mapInArrow(cut, schema), docs.columns, text_col)


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    raw = text.encode()
    folded = np.frombuffer(raw.translate(_FOLD), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], folded, [0])).astype(np.int8)))
    starts, ends, out, at = edge[::2], edge[1::2], [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, raw[at:]]).decode()


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The report of the query: one row per document, judged by ``20 * n_hit >= n_words``."""
    judged = contaminated(docs.select("doc_id", "text"), benchmark)
    return judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


#: DuckDB: every window of 13 words by equality, short items by their own length.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT item, w, least(13, len(w)) AS n, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def items_sha256(items: Iterable[str]) -> str:
    """The digest of a set of item names, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
