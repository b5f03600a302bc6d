"""Spelling variants: words at edit distance one, by a self-join of a trie with active-node sets.

Words are runs of letters with their counts. The trie of the vocabulary is partitioned by prefix. Walking down from
a node, its active set holds the other nodes within distance one: once the edit is spent, both sides go down in
lockstep, so a node at distance one follows the very letters of the walk or leaves the set. A pair is emitted where
the walk and an active node both end a word. The edit of a pair stands where the two words part, so each pair
arises at one node of the trie.

A cell is a subtrie. A cell of more than ``leaf_words`` words is split at its first branching, and the pairs that part
there are joined by Spark: nodes that go down in lockstep are words with equal rests, so the rows meet by (cell, rest);
such a group has a word for each letter and one more, no matter how many words the cell has. The other pairs lie within
one child. Cells that are small enough go down their trie in one task, cell by cell, in sorted order. The limit is
``leaf_words`` or a ten-thousandth of the vocabulary, whichever is more, so at most ten thousand cells are split at a
level: this table (a short key and a number) is what is broadcast. There are as many levels as branchings on the
way to a small cell (3 to 6 in real vocabularies); chains of letters without branching count as one step.

Forms point to words at least twice as frequent, so they have no circle and pointer jumping ends after a few joins.

Defined results: null texts have no words; a row without id counts as the empty id; unlike rows of one id and repeated
rows are occurrences of their own; runs of any length are read whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from os.path import commonprefix

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable

RUN = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_POINTS, MIN_COUNT, SLIPS = 5, 3, 97
LEAF_WORDS, SPLITS = 256, 10_000
#: Pairs of an Arrow batch.
BATCH = 1 << 14
_LAST = "\U0010ffff"

#: A vocabulary, and pairs in both orders.
PAIRS = "word string, near string, near_n long"


def _rest(word: Column, start: Column) -> Column:
    """The code points of ``word`` from ``start`` (from 0) on."""
    return F.substring(word, start + 1, F.length(word))


def vocabulary(docs: DataFrame, min_points: int = MIN_POINTS, min_count: int = MIN_COUNT) -> DataFrame:
    """``word`` and its count ``n``; runs whose hash says so lose a code point."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    low = runs.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % SLIPS == 0, F.concat(F.substring("run", F.lit(1), at), _rest(F.col("run"), at + 1))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= min_points).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def trie_pairs(words: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs of places in a sorted list of unlike words at distance one, in both orders.

    A node is a range of the list whose words share ``depth`` letters; so is an active node, which stands at distance one.
    """

    def follow(node: tuple[int, int, int], letters: str) -> tuple[int, int, int] | None:
        lo, hi, depth = node
        path = words[lo][:depth] + letters
        a = bisect_left(words, path, lo, hi)
        b = bisect_left(words, path + _LAST, a, hi)
        return (a, b, depth + len(letters)) if a < b else None

    def down(active: list[tuple[int, int, int]], letters: str) -> list[tuple[int, int, int]]:
        return [v for v in (follow(node, letters) for node in active) if v]

    stack: list[tuple[int, int, int, list[tuple[int, int, int]]]] = [(0, len(words), 0, [])] if words else []
    while stack:
        lo, hi, depth, active = stack.pop()
        word = words[lo]
        if hi - lo == 1:  # one word is left: each active node must end in its rest
            for a, b, at in active:
                want = words[a][:at] + word[depth:]
                m = bisect_left(words, want, a, b)
                if m < b and words[m] == want:
                    yield lo, m
            continue
        end = len(commonprefix((word, words[hi - 1])))
        if end > depth:
            active = down(active, word[depth:end])
        children, i = [], lo
        if len(word) == end:
            yield from ((lo, a) for a, _, at in active if len(words[a]) == at)
            i += 1
        while i < hi:
            j = bisect_left(words, words[i][: end + 1] + _LAST, i, hi)
            children.append((i, j, end + 1))
            i = j
        for child in children:
            a, b, at = child
            letter = words[a][end]
            if len(word) == end and len(words[a]) == at:
                yield lo, a  # the node's own word and one with a letter more
            others = [c for c in children if c is not child]
            replaced = others
            deleted = [(p, q, end) for p, q in ((lo, a), (b, hi)) if p < q]
            inserted = down(others, letter)
            stack.append((a, b, at, down(active, letter) + replaced + deleted + inserted))


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within each cell; rows come sorted by cell and word."""
    out: tuple[list, list, list] = ([], [], [])

    def flush() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["word", "near", "near_n"])
        for column in out:
            column.clear()
        return batch

    def solve(words: list[str], counts: list[int]) -> Iterator[pa.RecordBatch]:
        for i, j in trie_pairs(words):
            out[0].append(words[i])
            out[1].append(words[j])
            out[2].append(counts[j])
            if len(out[0]) >= BATCH:
                yield flush()

    cell, words, counts = None, [], []
    for batch in batches:
        for key, word, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if key != cell:
                yield from solve(words, counts)
                cell, words, counts = key, [], []
            words.append(word)
            counts.append(n)
    yield from solve(words, counts)
    yield flush()


@F.pandas_udf(T.IntegerType())
def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    """Letters that two words share at the start."""
    return pd.Series([len(commonprefix(pair)) for pair in zip(a, b, strict=True)], dtype="int32")


def _parting(split: DataFrame) -> DataFrame:
    """Pairs of words of a cell that part at ``k``, where the cell branches."""
    k, word = F.col("k"), F.col("word")
    long = F.struct(_rest(word, k + 1).alias("rest"), F.when(F.length(word) > k, F.substring(word, k + 1, F.lit(1))).alias("letter"))
    short = F.struct(_rest(word, k).alias("rest"), F.lit(None).cast("string").alias("letter"))
    sides = split.select("cell", "word", "n", F.explode(F.when(F.length(word) > k, F.array(long, short)).otherwise(F.array(short))).alias("side"))
    groups = sides.groupBy("cell", F.col("side.rest").alias("rest")).agg(F.collect_list(F.struct("side.letter", "word", "n")).alias("members")).where(F.size("members") > 1)
    pairs = groups.select("rest", "members", F.explode("members").alias("a")).select("rest", "a", F.explode("members").alias("b"))
    letter = F.coalesce("a.letter", "b.letter")
    both = F.col("a.letter").isNotNull() & F.col("b.letter").isNotNull()
    # a letter more parts the two here only if the shorter word goes on with another one
    return pairs.where((F.col("a.word") != F.col("b.word")) & (both | (letter != F.substring("rest", 1, 1)))).select(F.col("a.word").alias("word"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n"))


def near_pairs(words: DataFrame, leaf_words: int = LEAF_WORDS) -> DataFrame:
    """``word``, ``near`` and ``near_n`` of all pairs at distance one, in both orders; ``words`` has unlike ``word`` with ``n``."""
    state = words.select("word", "n", F.lit("").alias("cell"))
    limit = max(leaf_words, state.count() // SPLITS)
    found, leaves = [], []
    while True:
        large = state.groupBy("cell").agg(F.count("*").alias("size"), F.min("word").alias("low"), F.max("word").alias("high")).where(F.col("size") > limit)
        splits = durable(large.select("cell", _shared("low", "high").alias("k")))
        told = state.join(F.broadcast(splits), "cell", "left")  # at most SPLITS rows
        leaves.append(told.where("k is null").select("cell", "word", "n"))
        if splits.limit(1).count() == 0:
            break
        split = told.where("k is not null")
        found.append(_parting(split))
        state = durable(split.where(F.length("word") > F.col("k")).select("word", "n", F.concat("cell", F.substring("word", F.col("k") + 1, F.lit(1))).alias("cell")))
    small = reduce(DataFrame.unionByName, leaves).repartition("cell").sortWithinPartitions("cell", "word")
    return reduce(DataFrame.unionByName, found, small.mapInArrow(_leaves, PAIRS))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of words with a ``form``: forms followed to the last."""
    ahead = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("far"))
        new = durable(ahead.join(further, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        ahead = new.select("word", "root")
        if new.where("moved").limit(1).count() == 0:
            return ahead


def variants(words: DataFrame, leaf_words: int = LEAF_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of a vocabulary (``word``, ``n``)."""
    words = durable(words.select("word", "n"))
    near = near_pairs(words, leaf_words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("first"))
    formed = -F.col("first.rank") >= 2 * F.col("n")
    told = durable(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("first.near")).alias("form"), F.when(formed, -F.col("first.rank")).alias("form_n")
        )
    )
    last = roots(told.where("form is not null"))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def digest(docs: DataFrame) -> DataFrame:
    """The variants of the words of ``docs``."""
    return variants(vocabulary(docs))


_CRC = """tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t)"""
ORACLE = f"""WITH RECURSIVE {_CRC},
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '{RUN}')), '{_UPPER}', '{_LOWER}') AS run FROM documents),
per_doc AS (SELECT id, run, count(*) AS c, hex(encode(id || ':' || run)) AS x FROM runs GROUP BY ALL),
hashed AS (SELECT run, c, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)), lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM per_doc, tab),
slipped AS (SELECT c, CASE WHEN h % {SLIPS} = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
vocab AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM slipped WHERE length(word) >= {MIN_POINTS} GROUP BY word HAVING sum(c) >= {MIN_COUNT}),
cuts AS (SELECT word, n, i, left(word, CAST(i AS INT)) || substr(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocab)),
less AS (SELECT DISTINCT c.word AS long, c.n AS long_n, v.word AS short, v.n AS short_n FROM cuts c JOIN vocab v ON c.cut = v.word),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word UNION ALL SELECT long, short, short_n FROM less UNION ALL SELECT short, long, long_n FROM less),
ranked AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k FROM near),
told AS (SELECT v.word, v.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= 2 * v.n THEN r.near END AS form, CASE WHEN r.near_n >= 2 * v.n THEN r.near_n END AS form_n FROM vocab v LEFT JOIN ranked r ON v.word = r.word AND r.k = 1),
way(word, last, form) AS (SELECT word, word, form FROM told UNION ALL SELECT way.word, way.form, told.form FROM way JOIN told ON way.form = told.word)
SELECT told.word, told.form, way.last AS root, told.n, told.n_near, told.form_n FROM told JOIN way ON told.word = way.word AND way.form IS NULL"""
