"""Language identification with hyperdimensional profiles.

Each letter of any script has a bipolar vector of its own, drawn by a hash of its code point. A
trigram is bound from the vectors of its letters, each permuted (rolled) by its place; a document
bundles its trigrams, a language bundles its training documents, and a document goes to the language
whose prototype has the largest cosine.

Training counts trigrams within each task by a key of 63 bits and binds the distinct ones whenever
``HELD`` of a language are held, so memory does not grow with the alphabet and a task emits one
vector per language; Spark sums these few rows. Only prototypes (languages x dimensions) are
broadcast. Bundles are sums of integers: the result does not depend on the partitioning.

Defined results: null texts and texts without a letter get ``und`` and score 0; ties go to the
language that sorts first; null languages teach nothing; without any training row all documents
get ``und``; repeated rows count as often as they occur; very long texts are read whole, a slice of a million
characters at a time; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, unpacked

UNKNOWN = "und"
#: A code point takes 21 bits, a trigram 63; 0 stands for all that is no letter.
BITS = 21
_POINT = (1 << BITS) - 1
SLICE_CHARS = 1 << 20
#: Distinct trigrams that training holds for a language, and that a slice binds at once.
HELD = 1 << 18
BOUND = 1 << 16
PART = 8192
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


@lru_cache(maxsize=1)
def _alphabet() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(cp).isalpha() for cp in range(0x110000)), bool, 0x110000)


def _class_of(cp: int) -> int:
    """Each letter is a class of its own."""
    return cp


class _Letters:
    """Vectors of letters for one place of a trigram."""

    def __init__(self, dims: int, seed: int, shift: int):
        self.dims, self.start, self.shift = dims, np.uint64(seed * int(_MIX[0]) % 2**64), shift

    def __getitem__(self, letters) -> np.ndarray:
        found, at = np.unique(letters, return_inverse=True)
        words = np.arange(-(-self.dims // 64), dtype=np.uint64)
        x = (found.astype(np.uint64)[:, None] << np.uint64(32) | words) + self.start
        for _ in range(2):  # the finaliser of splitmix64
            x = x + _MIX[0]
            x = (x ^ x >> np.uint64(30)) * _MIX[1]
            x = (x ^ x >> np.uint64(27)) * _MIX[2]
            x ^= x >> np.uint64(31)
        bits = np.unpackbits(x.astype("<u8").view(np.uint8), axis=1)[:, : self.dims].astype(np.int8)
        return np.roll(bits * np.int8(2) - np.int8(1), self.shift, axis=1)[at.reshape(np.shape(letters))]


@lru_cache(maxsize=4)
def _letters(dims: int, seed: int) -> tuple[_Letters, ...]:
    """Vectors of the letters for the first, second and third place of a trigram."""
    return tuple(_Letters(dims, seed, shift) for shift in (2, 1, 0))


def bind(codes: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """Vectors of trigrams, a row for each code."""
    first, second, third = _letters(dims, seed)
    out = first[codes >> 2 * BITS]
    out *= second[codes >> BITS & _POINT]
    out *= third[codes & _POINT]
    return out


def _bundle(codes: np.ndarray, counts: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """Sum of the vectors of trigrams, each times its count."""
    v = np.zeros(dims)
    for i in range(0, len(codes), PART):
        v += counts[i : i + PART].astype(float) @ bind(codes[i : i + PART], dims, seed).astype(float)
    return v


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes of all texts and, for each, the index of its text; runs of non-letters count as one boundary."""
    low = [t.lower() for t in texts]
    points = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = np.where(_alphabet()[points], points, 0)
    owner = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    keep = classes > 0
    keep[1:] |= classes[:-1] > 0
    s, owner = np.concatenate(([0], classes[keep])).astype(np.int64), np.concatenate(([-1], owner[keep]))
    if len(s) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, of = (s[:-2] << BITS | s[1:-1]) << BITS | s[2:], owner[1:-1]
    own = (s[1:-1] > 0) | (owner[2:] == of)  # a boundary between two texts is no trigram's middle
    return code[own], of[own]


def long_trigrams(text: str, chars: int = SLICE_CHARS) -> Iterator[np.ndarray]:
    """The codes that ``trigrams`` gives for one text, a slice at a time."""
    low = text.lower() + "\n"
    last, kept = 0, np.zeros(1, np.int64)
    for a in range(0, len(low), chars):
        points = np.frombuffer(low[a : a + chars].encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = np.where(_alphabet()[points], points, 0).astype(np.int64)
        keep = classes > 0
        keep[1:] |= classes[:-1] > 0
        keep[0] |= last > 0
        last = int(classes[-1])
        s = np.concatenate((kept, classes[keep]))
        kept = s[-2:]
        yield (s[:-2] << BITS | s[1:-1]) << BITS | s[2:]


def _slices(values: list, chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of values of about ``chars`` characters; one with more stands alone."""
    start = total = 0
    for i, v in enumerate(values):
        if len(v or "") > chars:
            if start < i:
                yield start, i
            yield i, i + 1
            start, total = i + 1, 0
            continue
        total += len(v or "")
        if total >= chars:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(values):
        yield start, len(values)


def learn(train: DataFrame, text_col: str = "text", lang_col: str = "lang", dims: int = 1024, seed: int = 1, held_grams: int = HELD) -> dict[str, np.ndarray]:
    """Prototype of each language: the bundle of all trigrams of its documents."""
    rows = train.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        sums: dict[str, np.ndarray] = {}

        def settle(name: str, most: int) -> None:
            """Merge what is held for a language, and bind it where it is more than ``most`` trigrams."""
            parts = held[name]
            codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([n for _, n in parts]), len(codes))
            if len(codes) > most:
                sums[name] += _bundle(codes, counts, dims, seed)
                codes, counts = codes[:0], counts[:0]
            held[name] = [(codes, counts)]

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _slices(texts):
                if len(texts[a]) > SLICE_CHARS:
                    held.setdefault(langs[a], [])
                    sums.setdefault(langs[a], np.zeros(dims))
                    for code in long_trigrams(texts[a]):
                        own = held[langs[a]]
                        own.append(np.unique(code, return_counts=True))
                        if sum(len(c) for c, _ in own) > 2 * held_grams:
                            settle(langs[a], held_grams)
                    continue
                code, of = trigrams(texts[a:b])
                names = sorted(set(langs[a:b]))
                lang_of = np.array([names.index(x) for x in langs[a:b]])[of]
                for k, name in enumerate(names):
                    own = held.setdefault(name, [])
                    sums.setdefault(name, np.zeros(dims))
                    own.append(np.unique(code[lang_of == k] if len(names) > 1 else code, return_counts=True))
                    if sum(len(c) for c, _ in own) > 2 * held_grams:
                        settle(name, held_grams)
        for name in held:
            settle(name, 0)
        names = sorted(sums)
        vectors = [sums[name].astype(np.int64) for name in names]
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(vectors, pa.list_(pa.int64()))], names=["lang", "v"])

    parts = rows.mapInArrow(bundle, "lang string, v array<long>").select("lang", F.posexplode("v").alias("pos", "x"))
    whole = parts.groupBy("lang", "pos").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in whole.toLocalIterator():
        out.setdefault(r.lang, np.zeros(dims))[r.pos] = r.x
    return out


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", dims: int = 1024, seed: int = 1) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the cosine with the prototype (negative ones as 0)."""
    langs = sorted(prototypes)
    basis = np.array([prototypes[x] / (np.linalg.norm(prototypes[x]) or 1.0) for x in langs]).reshape(len(langs), dims)
    shared = docs.sparkSession.sparkContext.broadcast((langs, basis))
    kept = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score")])
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = kept.columns.index(text_col)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, basis = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for a, b in _slices(texts) if names else ():
                for i, v in _bundles([t or "" for t in texts[a:b]], dims, seed):
                    cos = basis @ v / (np.linalg.norm(v) or 1.0)
                    best = int(cos.argmax())
                    pred[a + i], score[a + i] = names[best], min(1.0, max(0.0, cos[best]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred), pa.array(score)], names=schema.fieldNames())

    return kept.mapInArrow(classify, schema)


def _bundles(texts: list[str], dims: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """Index and vector of each text that has a letter; a long text comes alone."""
    if len(texts[0]) > SLICE_CHARS:
        v, some = np.zeros(dims), False
        for code in long_trigrams(texts[0]):
            some |= len(code) > 0
            v += _bundle(*np.unique(code, return_counts=True), dims, seed)
        if some:
            yield 0, v
        return
    code, of = trigrams(texts)
    if not len(code):
        return
    seen, row = np.unique(code, return_inverse=True)
    key = np.sort(of * len(seen) + row)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(first, len(key))).astype(np.float32)
    doc, row = key[first] // len(seen), key[first] % len(seen)
    vectors = bind(seen, dims, seed) if len(seen) <= BOUND else None  # else by document, so that memory stays bounded
    starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(doc)], strict=True):
        if vectors is None:
            yield int(doc[a]), _bundle(seen[row[a:b]], count[a:b], dims, seed)
            continue
        v = np.zeros(dims)
        for i in range(a, b, PART):
            j = min(b, i + PART)
            v += count[i:j] @ vectors[row[i:j]].astype(np.float32)
        yield int(doc[a]), v


def held_out(doc_id: Column) -> Column:
    """The documents that never teach."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, learned from those of them that are not held out."""
    return predict(docs, learn(docs.where(~held_out(F.col("doc_id")))))


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents with a language, which becomes their ``lang``; those without a letter go."""
    found = predict(packed(docs, "text", "lang"), learn(docs.where(~held_out(F.col("doc_id"))))).where(F.col("lang_pred") != UNKNOWN)
    return unpacked(found.withColumn("lang", F.col("lang_pred")), docs.columns, "text", "lang")


def digest(docs: DataFrame) -> DataFrame:
    """The report of the query: one row per document."""
    return classify(docs.select("doc_id", "text", "lang")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
