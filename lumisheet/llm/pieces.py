"""SentencePiece (BPE) encoding and decoding by suffix-array matching.

Per batch, the distinct chunks (a word with the space before it) are concatenated and indexed by a suffix
array over as many characters as the longest piece has. Every piece is looked up by binary search; its range in
the array gives its occurrences, the edges. Edges are sorted by where they end and relaxed in that order: an edge
is taken if its piece may follow the piece that ends where it starts. For BPE exactly one edge into each place is
taken (two pieces may follow each other if no merge across their border comes before the merges that made
them), so the result is that of the merges themselves, without running them.

Pieces hold no space mark after another character, so chunks are independent. Characters outside
the vocabulary become the bytes of their UTF-8 form. Workers keep the tokens of short chunks they have seen, up to ``cache``
tokens; longer chunks are encoded anew, so memory does not grow with texts that have no spaces.

Scale: one pass, no shuffle; the vocabulary (32,000 pieces) is broadcast. Defined results: null and empty texts
have no tokens; repeated rows are encoded alike; very long texts are read whole; an empty table gives an empty result; other columns are kept.
Decoding gives the text back, but for U+2581, which the model itself equates with a space.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .repeats import multikey_order

#: The model of the public tokenizers; any BPE model with byte fallback, identity normalisation and a dummy prefix will do.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
KEPT_CHARS = 64  # of a chunk whose tokens a worker keeps
SLICE_CHARS = 1 << 20  # of text that a worker holds as chunks at once
INDEX_CHARS = 1 << 18  # of new chunks under one suffix array
_NONE = np.iinfo(np.int64).max


def load(path: str = MODEL) -> list[tuple[str, float, bool]]:
    """(piece, score, is it a byte) of each id; control pieces are empty."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = lambda i: not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
    return [(sp.id_to_piece(i) if plain(i) else "", sp.get_score(i), sp.is_byte(i)) for i in range(sp.get_piece_size())]


class Vocabulary:
    """Tables of a model, made once in each process."""

    def __init__(self, pieces: list[tuple[str, float, bool]]):
        self.ids = {p: i for i, (p, _, byte) in enumerate(pieces) if p and not byte}
        self.byte_ids = np.zeros(256, np.int32)
        self.bytes = [b""] * len(pieces)
        for i, (p, _, byte) in enumerate(pieces):
            if byte:
                self.byte_ids[int(p[3:5], 16)] = i
                self.bytes[i] = bytes([int(p[3:5], 16)])
            else:
                self.bytes[i] = p.replace(SPACE, " ").encode()
        self.unknown = len(pieces)  # stands for one character outside the vocabulary
        score = np.array([s for _, s, _ in pieces])
        multi = [p for p in self.ids if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in multi):
            raise ValueError("a piece holds a space mark after another character")
        runs = {p for p in multi if not p.strip(SPACE)}
        own = [p for p in multi if p not in runs]
        if len({score[self.ids[p]] for p in own}) < len(own):
            raise ValueError("scores of pieces tie")
        self.rank = np.full(len(pieces) + 1, -1, np.int64)  # order of the merges; -1: a single character
        for r, i in enumerate(sorted((self.ids[p] for p in multi), key=lambda i: -score[i])):
            self.rank[i] = r
        for p in runs:  # runs of spaces tie with each other, after all others
            self.rank[self.ids[p]] = len(multi)
        pairs = {(self.ids[p[:k]] << 32) | self.ids[p[k:]]: self.rank[self.ids[p]] for p in multi for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        # the last merge of each piece, and the pieces whose parts are made later than the rank says
        self.left, self.right = np.full(len(pieces) + 1, -1, np.int64), np.full(len(pieces) + 1, -1, np.int64)
        usable = [p for p in self.ids if len(p) == 1]
        odd = np.zeros(len(pieces) + 1, bool)
        for p in sorted(own, key=len):
            got = self.merge(p)
            if len(got[0]) == 1:
                i, (a, b) = self.ids[p], got[1]
                usable.append(p)
                self.left[i], self.right[i] = a, b
                odd[i] = odd[a] or odd[b] or max(self.rank[a], self.rank[b]) > self.rank[i]
        self.odd = odd
        alphabet = {c: k + 1 for k, c in enumerate(sorted({c for p in self.ids for c in p}))}
        cut = "".join(c for c in "\n\t\r" if c not in alphabet)  # in no piece, so chunks end there as well
        self.chunks = re.compile(rf"[{cut}]|{SPACE}*[^{SPACE}{cut}]+|{SPACE}+" if cut else rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.symbol = np.zeros(0x110000, np.uint16)
        for c, k in alphabet.items():
            self.symbol[ord(c)] = k
        self.longest = -(-max(map(len, usable)) // 4) * 4
        self.text = np.zeros((len(usable), self.longest), np.uint64)
        for k, p in enumerate(usable):
            self.text[k, : len(p)] = [alphabet[c] for c in p]
        self.token = np.array([self.ids[p] for p in usable], np.int32)
        self.size = np.array([len(p) for p in usable], np.int64)
        self.length = np.ones(len(pieces) + 1, np.int64)
        self.length[self.token] = self.size
        # keys of four characters: the least and the greatest suffix that begin with a piece
        self.low = _packed(self.text)
        beyond = self.text.copy()
        beyond[np.arange(self.longest)[None, :] >= self.size[:, None]] = 0xFFFF
        self.high = _packed(beyond)
        self.seen_keys = np.full(1 << 21, -1, np.int64)
        self.seen = np.zeros(1 << 21, bool)
        self.cache: dict[str, int] = {}
        self.clear()

    def merge(self, chunk: str) -> tuple[list[int], tuple[int, int] | None]:
        """Tokens of a chunk by merging pairs, best first, and the last pair merged; for tables and rare chunks."""
        ids = [self.ids.get(c, self.unknown) for c in chunk]
        text = list(chunk)
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap: list[tuple[int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < len(ids):
                got = self.ids.get(text[i] + text[j])
                if got is not None:
                    heapq.heappush(heap, (int(self.rank[got]), i, text[i] + text[j]))

        for i in range(len(ids) - 1):
            offer(i)
        last = None
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if not text[i] or j >= len(ids) or text[i] + text[j] != both:
                continue
            last = ids[i], ids[j]
            ids[i], text[i], text[j] = self.ids[both], both, ""
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [ids[i] for i in range(len(ids)) if text[i]], last

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether token b may stand right after token a; remembered by pair."""
        key = a.astype(np.int64) << 32 | b
        slot = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(43)).astype(np.int64)
        out = self.seen[slot]
        miss = np.flatnonzero(self.seen_keys[slot] != key)
        if len(miss):
            fresh, back = np.unique(key[miss], return_inverse=True)
            ok = self._compare(fresh >> 32, fresh & 0xFFFFFFFF)
            out[miss] = ok[back]
            # keys that share a slot: the last one stays, whole
            at = slot[miss]
            self.seen_keys[at] = -1
            keep = dict(zip(at.tolist(), miss.tolist(), strict=True))
            at, miss = np.array(list(keep), np.int64), np.array(list(keep.values()), np.int64)
            self.seen_keys[at], self.seen[at] = key[miss], out[miss]
        return out

    def _compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.ones(len(a), bool)
        rows = np.flatnonzero((a != self.unknown) & (b != self.unknown))
        for i in rows[self.odd[a[rows]] | self.odd[b[rows]]].tolist():  # few pieces: by merging
            text = self.bytes[a[i]] + self.bytes[b[i]]
            ok[i] = self.merge(text.decode().replace(" ", SPACE))[0] == [a[i], b[i]]
        rows = rows[~(self.odd[a[rows]] | self.odd[b[rows]])]
        # back in time from the finished pieces: undo the later of the two merges at the border, and see
        # whether the border itself would have merged before
        x, y, limit = a[rows], b[rows], np.full(len(rows), _NONE)
        while len(rows):
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            across = np.where(self.pair_keys[at] == key, 2 * self.pair_ranks[at], _NONE)
            bad = across < limit
            ok[rows[bad]] = False
            go = ~bad & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            rows, x, y = rows[go], x[go], y[go]
            undo_left = self.rank[x] > self.rank[y]  # of equal merges the left one came first
            limit = np.where(undo_left, 2 * self.rank[x], 2 * self.rank[y] + 1)
            x, y = np.where(undo_left, self.right[x], x), np.where(undo_left, y, self.left[y])
        return ok

    def edges(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and index of each piece occurrence in a text of symbols (0: a break)."""
        padded = np.concatenate((symbols.astype(np.uint64), np.zeros(self.longest, np.uint64)))
        n = len(symbols)
        four = padded[: n + self.longest - 3] << np.uint64(48) | padded[1 : n + self.longest - 2] << np.uint64(32) | padded[2 : n + self.longest - 1] << np.uint64(16) | padded[3 : n + self.longest]
        keys = [four[k : k + n] for k in range(0, self.longest, 4)]
        order = multikey_order(keys)
        keys = [k[order] for k in keys]
        lo, hi = _search(keys, self.low, False), _search(keys, self.high, True)
        count = hi - lo
        piece = np.repeat(np.arange(len(lo)), count)
        at = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        return order[at], piece

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of chunks (none with two spaces in a row), end to end, and the number of each."""
        points = np.frombuffer(("\0".join(chunks) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.symbol[points]
        sizes = np.array([len(c) for c in chunks])
        starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        inside = np.ones(len(points), bool)
        inside[starts + sizes] = False
        start, piece = self.edges(symbols)
        # no merge runs over a place that no piece crosses, so what lies between such places is on its own
        crossed = np.cumsum(np.bincount(start + 1, minlength=len(points) + 2) - np.bincount(start + self.size[piece], minlength=len(points) + 2))[: len(points)]
        free = inside & (crossed == 0)
        offset = np.arange(len(points)) - np.maximum.accumulate(np.where(free, np.arange(len(points)), 0))
        token, end = self.token[piece], start + self.size[piece]
        strange = np.flatnonzero(inside & (symbols == 0))
        start, token, end = np.concatenate((start, strange)), np.concatenate((token, np.full(len(strange), self.unknown, np.int32))), np.concatenate((end, strange + 1))
        depth = offset[end - 1] + 1
        order = np.argsort(depth.astype(np.uint16), kind="stable") if depth.max(initial=0) < 1 << 16 else np.argsort(depth, kind="stable")
        start, token, end, depth = start[order], token[order], end[order], depth[order]
        cuts = np.flatnonzero(np.diff(depth)) + 1
        last = np.full(len(points) + 1, -1, np.int64)  # the token that ends before a place
        for s, t, e in zip(np.split(start, cuts), np.split(token, cuts), np.split(end, cuts), strict=True):
            ok = offset[s] == 0
            rest = np.flatnonzero(~ok)
            if len(rest):
                ok[rest] = self.may_follow(last[s[rest]], t[rest])
            last[e[ok]] = t[ok]
        ends = np.zeros(len(points) + 1, bool)
        free[starts] = False
        at = np.concatenate(((starts + sizes)[sizes > 0], np.flatnonzero(free)))
        while len(at):
            ends[at] = True
            at = at - self.length[last[at]]
            at = at[offset[at] > 0]
        where = np.flatnonzero(ends)
        out = last[where].astype(np.int32)
        chunk = np.searchsorted(starts, where - 1, side="right") - 1
        odd = np.flatnonzero(out == self.unknown)
        if len(odd):
            raw = [np.frombuffer(chr(points[p - 1]).encode("utf-8", "surrogatepass"), np.uint8) for p in where[odd].tolist()]
            times = np.ones(len(out), np.int64)
            times[odd] = [len(r) for r in raw]
            chunk, out = np.repeat(chunk, times), np.repeat(out, times)
            out[out == self.unknown] = self.byte_ids[np.concatenate(raw)]
        return out, np.bincount(chunk, minlength=len(chunks))

    def clear(self) -> None:
        self.cache.clear()
        self.store, self.first, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str], cache: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts, end to end, and the number of each. Chunks of up to ``KEPT_CHARS`` stay known until there are ``cache`` tokens of them."""
        parts = [self.chunks.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        fresh = list(dict.fromkeys(c for p in parts for c in p if c not in self.cache))
        first, count, store, known = self.first, self.count, self.store, self.cache
        if fresh:
            short, long = [c for c in fresh if len(c) <= KEPT_CHARS], [c for c in fresh if len(c) > KEPT_CHARS]
            names, parted = [], []
            for part in (short, long):  # those to keep come first
                plain, spaced = [c for c in part if c[:2] != SPACE * 2], [c for c in part if c[:2] == SPACE * 2]
                names += plain + spaced
                parted += [self.encode_chunks(p) for p in _grouped(plain, INDEX_CHARS)]
                parted += [(np.array(t, np.int32), np.array([len(t)], np.int64)) for t in map(self._spaced, spaced)]
            coded, sizes = (np.concatenate(x) for x in zip(*parted, strict=True))
            kept, ends = len(short), len(store) + np.cumsum(sizes)
            first, count, store = np.concatenate((first, ends - sizes)), np.concatenate((count, sizes)), np.concatenate((store, coded)).astype(np.int32)
            old = len(self.cache)
            self.cache.update((c, old + k) for k, c in enumerate(names[:kept]))
            known = self.cache
            self.first, self.count, self.store = first, count, store
            if long:
                known = known | {c: old + k for k, c in enumerate(names[kept:], kept)}
                self.first, self.count, self.store = first[: old + kept].copy(), count[: old + kept].copy(), store[: int(ends[kept - 1]) if kept else len(self.store)].copy()
        get = known.__getitem__
        of = np.fromiter((get(c) for p in parts for c in p), np.int64)
        n = count[of]
        tokens = store[np.repeat(first[of] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        bounds = np.concatenate(([0], np.cumsum(n)))[np.cumsum([0, *map(len, parts)])]
        if len(self.store) > cache:
            self.clear()
        return tokens, np.diff(bounds)

    def _spaced(self, chunk: str) -> np.ndarray:
        """A chunk with spaces in front: the last one goes with the word if it merges, the others among themselves."""
        word = chunk.lstrip(SPACE)
        spaces = len(chunk) - len(word)
        tail = self.encode_chunks([SPACE + word])[0] if word else self.byte_ids[:0]
        if len(tail) and tail[0] == self.ids[SPACE]:
            tail = tail[1:]
        elif len(tail):
            spaces -= 1
        return np.concatenate((np.array(self.merge(SPACE * spaces)[0], np.int32), tail))

    def decode(self, tokens: list[int] | None) -> str:
        """The text of tokens, without the space that encoding put in front."""
        raw = b"".join(map(self.bytes.__getitem__, tokens or ()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def _grouped(chunks: list[str], chars: int) -> Iterator[list[str]]:
    start = size = 0
    for i, c in enumerate(chunks):
        size += len(c)
        if size >= chars:
            yield chunks[start : i + 1]
            start, size = i + 1, 0
    if start < len(chunks):
        yield chunks[start:]


def _packed(text: np.ndarray) -> list[np.ndarray]:
    return [text[:, k] << np.uint64(48) | text[:, k + 1] << np.uint64(32) | text[:, k + 2] << np.uint64(16) | text[:, k + 3] for k in range(0, text.shape[1], 4)]


def _search(keys: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
    """Binary search of rows of several keys: the first place that is not less (``after``: greater)."""
    lo, hi = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(keys[0]), np.int64)
    while (open_ := lo < hi).any():
        mid = np.minimum((lo + hi) >> 1, len(keys[0]) - 1)
        less, tie = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for key, want in zip(keys, wanted, strict=True):
            own = key[mid]
            less |= tie & (own < want)
            tie &= own == want
        less |= tie & after
        lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
    return lo


@lru_cache(maxsize=2)
def _vocabulary(pieces: tuple[tuple[str, float, bool], ...]) -> Vocabulary:
    return Vocabulary(list(pieces))


def encode(docs: DataFrame, text_col: str = "text", model: str = MODEL, cache: int = 1 << 20, check: bool = False) -> DataFrame:
    """``docs`` with ``ids`` instead of the text; ``check`` adds ``exact``, whether decoding gives the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(load(model)))
    rest = [f for f in docs.schema.fields if f.name not in (text_col, "ids", "exact")]
    schema = T.StructType([*rest, T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField("exact", T.BooleanType())] if check else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared.value)
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                texts, size = [], 0
                while start + len(texts) < batch.num_rows and size < SLICE_CHARS:
                    texts.append(batch.column(batch.num_columns - 1)[start + len(texts)].as_py())
                    size += len(texts[-1] or "")
                tokens, n = vocabulary.encode(texts, cache)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(tokens))
                own = [*batch.slice(start, len(texts)).columns[:-1], ids]
                if check:
                    ends = np.cumsum(n).tolist()
                    own.append(pa.array([vocabulary.decode(tokens[b - k : b].tolist()) == (t or "") for t, b, k in zip(texts, ends, n.tolist(), strict=True)]))
                yield pa.RecordBatch.from_arrays(own, names=schema.fieldNames())
                start += len(texts)

    return docs.select(*[f.name for f in rest], text_col).mapInArrow(run, schema)


def decode(tokens: DataFrame, ids_col: str = "ids", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``tokens`` with the text instead of the ids; null ids give an empty text."""
    shared = tokens.sparkSession.sparkContext.broadcast(tuple(load(model)))
    rest = [f for f in tokens.schema.fields if f.name not in (text_col, ids_col)]
    schema = T.StructType([*rest, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared.value)
        for batch in batches:
            texts = [vocabulary.decode(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=schema.fieldNames())

    return tokens.select(*[f.name for f in rest], ids_col).mapInArrow(run, schema)


def encoded(docs: DataFrame) -> DataFrame:
    """Documents as tokens: all columns but the text and its length, then ``ids``, ``exact`` and ``n_tokens``."""
    return encode(docs.drop("n_chars"), check=True).withColumn("n_tokens", F.size("ids").cast("long"))


def digest(docs: DataFrame) -> DataFrame:
    """The report of the query: one row per document with its tokens, and whether they decode to its text."""
    return encode(docs.select("doc_id", "text"), check=True).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "exact")
