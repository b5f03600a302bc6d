import random

import numpy as np
import pytest
import xxhash

from lumisheet.llm import simhash
from lumisheet.llm.common import table


def brute_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(prints, ids, bits=4):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(prints)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min(groups[find(i)]) for i in range(len(prints))]


def test_fingerprint():
    for t in ("", None, " \t", "one", "A b C d", "a b c d e f", "x " * 5000, "日本 語 É é é"):
        assert simhash.fingerprint(None if t is None else t.encode()) == brute_print(t)


@pytest.mark.parametrize(("shard_rows", "block_rows", "leaf_rows"), [(1 << 18, 1 << 20, 256), (16, 1 << 20, 2), (16, 25, 2), (4, 3, 1)])
def test_links_are_exact(spark, shard_rows, block_rows, leaf_rows):
    rng = random.Random(shard_rows)
    prints = []
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 3, 12])):
            for _ in range(rng.randint(0, 3)):
                base ^= 1 << rng.randrange(64)
            prints.append(base)
    prints = list(dict.fromkeys([*prints, 0, (1 << 64) - 1, 15]))
    ids = list(range(100, 100 + len(prints)))
    rng.shuffle(ids)
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in zip(ids, prints, strict=True)], "doc_id long, fp long")
    got = {r.fp % (1 << 64): r.head_id for r in simhash.near_components(df, shard_rows=shard_rows, block_rows=block_rows, leaf_rows=leaf_rows).collect()}
    assert [got[p] for p in prints] == brute_components(prints, ids)


@pytest.mark.parametrize("max_bits", [0, 1, 3, 4, 7])
def test_trees_send_near_prints_to_a_common_leaf(max_bits):
    rng = np.random.default_rng(max_bits)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000, dtype=np.uint64)
    near = base.copy()
    for i, n in enumerate(rng.integers(0, max_bits + 1, len(near)).tolist()):
        for bit in rng.choice(64, n, replace=False).tolist():
            near[i] ^= np.uint64(1 << bit)
    parts = simhash.lanes(list(range(64)), max_bits)
    assert sum(int(mask) for mask, _ in parts) == (1 << 64) - 1 and sum(r + 1 for _, r in parts) == max_bits + 1
    met = np.zeros(len(base), bool)
    for mask, radius in parts:
        tree = simhash.VantageTree(base[:1000], mask, radius, 20, 1)
        places = [{} for _ in range(2)]
        for of, x in zip(places, (base, near), strict=True):
            for row, leaf in zip(*(c.tolist() for c in tree.route(x)), strict=True):
                of.setdefault(row, set()).add(leaf)
        assert tree.leaves > 40
        met |= [bool(places[0][i] & places[1][i]) for i in range(len(base))]
    assert met.all()


def test_shards_are_searched_exactly():
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(300)]
    for _ in range(900):
        p = rng.choice(prints)
        for bit in rng.sample(range(64), rng.randint(1, 5)):
            p ^= 1 << bit
        prints.append(p)
    x = np.array(sorted(set(prints)), np.uint64)
    expected = simhash.forest(len(x), simhash._links(x, None, 4))
    assert (expected != np.arange(len(x))).sum() > 300
    assert simhash.shard_forest(x, None, list(range(21, 64)), 4, leaf_rows=16).tolist() == expected.tolist()
    side = np.arange(len(x)) % 2
    across = simhash.forest(len(x), simhash._links(x, side, 4))
    assert simhash.shard_forest(x, side, list(range(21, 64)), 4, leaf_rows=16).tolist() == across.tolist() != expected.tolist()


def test_documents_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    prints = [brute_print(r.text) for r in rows]
    got = {r.doc_id: r for r in simhash.digest(docs).collect()}
    assert [got[r.doc_id].fingerprint for r in rows] == [f"{p:016x}" for p in prints]
    assert [got[r.doc_id].component_id for r in rows] == brute_components(prints, [r.doc_id for r in rows])


def test_odd_rows(odd_docs, empty_docs):
    rows = simhash.digest(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == "0" * 16 and by[3].component_id == 1
    assert by[6].component_id == 0 and by[8].component_id == 7
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [0, 1, 4, 5, 7, 9, None]))
    assert simhash.digest(empty_docs).count() == 0 and simhash.keep_first(empty_docs).count() == 0


UNLIKE = [" ".join(f"{w}{k}" for k in range(40)) for w in ("red", "green", "blue")]


@pytest.mark.parametrize(
    ("rows", "stays"),
    [
        ([(5, 0), (5, 1), (7, 2)], [(5, 0), (5, 1), (7, 2)]),
        ([(3, 1), (5, 0), (5, 1)], [(3, 1), (5, 0)]),
        ([(5, 0), (5, 0), (6, 0), (6, 2)], [(5, 0), (6, 2)]),
        ([(None, 0), (5, 0), (None, 0)], [(None, 0), (5, 0), (None, 0)]),
    ],
)
def test_keep_first_judges_texts_not_ids(spark, sf_dir, rows, stays):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, UNLIKE[t], t) for i, t in rows], "doc_id long, text string, _h int").repartition(3)
    for kept in (simhash.keep_first(docs), dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, sf_dir)):
        assert kept.columns == docs.columns
        assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted((str(i), UNLIKE[t]) for i, t in stays)


def test_equal_prints_of_unlike_texts_under_one_id(spark):
    docs = spark.createDataFrame([(1, "A B"), (1, "a b"), (1, "a  b"), (2, "a b")], "doc_id long, text string")
    kept = [r.text for r in simhash.keep_first(docs).collect()]
    assert kept == [min(("A B", "a b", "a  b"), key=lambda t: np.uint64(xxhash.xxh64_intdigest(t, 42)).astype(np.int64))]
