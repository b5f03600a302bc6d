import hashlib
import random

import numpy as np
import pytest

from lumisheet.llm import repeats
from lumisheet.llm.common import table


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = repeats.brute([(i, (t or "").encode()) for i, t in rows], options.get("length", 100))
    text = dict(rows)
    got = {(r.doc_id, (text[r.doc_id] or "").encode()): (r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in repeats.remove_repeats(docs, **options).collect()}
    assert got == expected


def texts(seed, n, passages=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(rng.randint(15, 80))) for _ in range(passages)]
    out = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randint(0, len(p) // 2)
            parts += [p[a : a + rng.randint(80, 300)], word()]
        out.append((i, "".join(parts)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_all_strings(spark, seed):
    check(spark, texts(seed, 60), bucket_rows=50)


def test_periodic_and_tiny_texts(spark):
    rows = [(1, "a" * 1000), (2, "ab" * 300), (3, "x" + "a" * 99), (4, "a" * 100), (5, "a" * 99), (6, ""), (7, None), (8, "abc" * 200 + "é" * 200), (9, "é" * 150)]
    check(spark, rows)
    check(spark, rows, bucket_rows=7)
    check(spark, rows, length=40, bucket_rows=20)


def test_long_texts_in_slices(spark, monkeypatch):
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefg ") for _ in range(30_000))
    rows = [(1, base), (2, base[:15_000] + "#" + base[15_000:]), (3, base[29_000:] + base[:900])]
    check(spark, rows)
    ids, raw = [(1, 0), (2, 0)], [base.encode(), base[5000:9000].encode()]
    whole = {(int(g), int(c)) for group in repeats._pieces(ids, raw, 100) for a in [repeats.anchors(group)] for g, c in zip(a["gram"], a["c1"], strict=True)}
    monkeypatch.setattr(repeats, "SLICE", 1 << 12)
    cut = {(int(g), int(c)) for group in repeats._pieces(ids, raw, 100) for a in [repeats.anchors(group)] for g, c in zip(a["gram"], a["c1"], strict=True)}
    assert len(whole & cut) > 0.9 * len(whole)


def test_order_by_several_keys():
    rng = np.random.default_rng(0)
    keys = [rng.integers(0, 4, 5000), rng.integers(-3, 3, 5000), rng.integers(0, 50, 5000)]
    order = repeats.multikey_order(keys)
    rows = np.column_stack(keys)[order]
    assert rows.tolist() == sorted(np.column_stack(keys).tolist())
    assert len(repeats.multikey_order([np.zeros(0, np.int64)] * 2)) == 0


def test_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    expected = repeats.brute([(r.doc_id, r.text.encode()) for r in docs.collect()])
    assert {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digest(docs).collect()} == {i: v for (i, _), v in expected.items()}


def test_odd_rows(odd_docs, empty_docs):
    rows = repeats.digest(odd_docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == odd_docs.count() and by[8].n_removed == by[8].n_bytes and by[7].n_removed > 0 and by[1].n_bytes == 0 and by[None].n_removed == 0
    assert repeats.digest(empty_docs).count() == 0


@pytest.mark.parametrize("bucket_rows", [5, 400_000])
def test_repeated_rows_are_one_document(spark, bucket_rows):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    base = text(1000)
    rows = [(1, base), (2, text(50) + base[200:700] + text(50)), (3, base[:300] + text(400) + base[:300]), (4, text(1000))]
    expected = {i: v for (i, _), v in repeats.brute([(i, t.encode()) for i, t in rows]).items()}
    assert expected[1][0] == expected[4][0] == 0 < min(expected[2][0], expected[3][0])
    docs = spark.createDataFrame(rows + rows + rows[:1], "doc_id long, text string").repartition(3)
    got = [(r.doc_id, (r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())) for r in repeats.remove_repeats(docs, bucket_rows=bucket_rows).collect()]
    assert len(got) == 9 and all(found == expected[i] for i, found in got)


@pytest.mark.parametrize("bucket_rows", [5, 400_000])
def test_unlike_texts_under_one_id(spark, bucket_rows):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    base = text(600)
    rows = [(1, base), (1, text(30) + base[100:500]), (1, base), (2, base[:250] + text(90)), (2, None), (2, ""), (0, base[300:450])]
    expected = repeats.brute([(i, (t or "").encode()) for i, t in rows])
    found = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), bucket_rows=bucket_rows).collect()
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found)
    assert got == sorted((i, len((t or "").encode()), *expected[i, (t or "").encode()]) for i, t in rows)


def test_string_classes_compare_bytes():
    rng = random.Random(3)
    parts = [bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(3)]
    rows = [(gram := rng.choice((b"x" * 24, b"y" * 24)), rng.choice(parts)[:8], gram + rng.choice(parts)[:8]) for _ in range(40)]
    length, wide = 32, np.zeros((40, 8), np.uint8)
    suffix = np.array([list(s) for _, _, s in rows], np.uint8)
    for i, (_, b, _) in enumerate(rows):
        wide[i] = list(b[::-1])
    seen, expected, got = set(), set(), set()
    for i, (_, b, s) in enumerate(rows):
        for o in range(9):
            string = b[8 - o :] + s[: length - o]
            (expected.add((i, o)) if (o, string) in seen else seen.add((o, string)))
    for o, own, again in repeats.string_classes(suffix, np.full(40, 32), wide, np.full(40, 8), length):
        got |= {(i, o) for i in own[again].tolist()}
    assert got == expected and 0 < len(got) < 360


def test_sql_of_all_strings(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    expected = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({repeats.ORACLE})").fetchall())
    assert sorted(map(tuple, repeats.digest(table(spark, sf_dir, "documents")).select(*names).collect())) == expected
