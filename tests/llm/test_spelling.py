import random
import re
import time
import zlib
from collections import Counter

import duckdb
import pytest

from lumisheet.llm import spelling
from lumisheet.llm.common import table


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute_pairs(words):
    return sorted((a, b) for a in words for b in words if one_apart(a, b))


def brute(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall(spelling.RUN, text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) if near[w] else None for w in n}
    form = {w: v if v and n[v] >= 2 * n[w] else None for w, v in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def told(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def vocabularies():
    rng = random.Random(5)
    yield []
    yield ["a"]
    yield ["a", "aa", "aaa", "aaaa", "ab", "b", "ba"]
    yield sorted({"a" * n for n in range(1, 60)})
    yield sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(300)})
    yield sorted({"".join(rng.choice("abcdé÷") for _ in range(rng.randint(3, 6))) for _ in range(700)})
    yield sorted({"prefix" * 3 + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 5))) for _ in range(200)})


def test_trie_against_all_pairs():
    for words in vocabularies():
        assert sorted((words[i], words[j]) for i, j in spelling.trie_pairs(words)) == brute_pairs(words)


def test_long_words_are_cheap():
    words = sorted(["x" * 300_000, "x" * 300_001, "x" * 150_000 + "y" + "x" * 149_999, "x" * 150_000 + "y" + "x" * 150_000])
    began = time.perf_counter()
    assert sorted(spelling.trie_pairs(words)) == sorted((words.index(a), words.index(b)) for a in words for b in words if one_apart(a, b))
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize("leaf", [2, 40])
def test_split_cells_against_all_pairs(spark, leaf):
    for k, words in enumerate(vocabularies()):
        if k not in (2, 3, 5, 6) or (k == 3 and leaf < 40):  # words that are beginnings of each other part a level at a time
            continue
        words = words[:150]
        df = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
        got = spelling.near_pairs(df, leaf).collect()
        assert sorted((r.word, r.near) for r in got) == brute_pairs(words)
        assert all(words[r.near_n - 1] == r.near for r in got)


def test_table_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.execute("SELECT word, form, root, n, n_near, form_n FROM (" + spelling.ORACLE + ")").fetchall())
    got = told(spelling.digest(table(spark, sf_dir, "documents")))
    assert got == want and sum(r[1] is not None for r in got) > 20


def test_small_corpora_against_brute_force(spark):
    rng = random.Random(8)
    bases = ["".join(rng.choice("abc") for _ in range(rng.randint(4, 7))) for _ in range(60)]
    docs = [(i, " ".join(rng.choice(bases) if rng.random() < 0.7 else rng.choice(bases).title()[:-1] + "É" for _ in range(rng.randint(0, 400)))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    got = told(spelling.digest(df))
    assert got == want and any(r[1] for r in want)
    assert told(spelling.digest(df.union(df.where("1 = 0")).repartition(7))) == want


def test_forms_lead_to_the_last(spark):
    chain = ["abcdefghij"[:k] + "0123456789"[k:] for k in range(10)]
    df = spark.createDataFrame([(w, 3 * 2**k) for k, w in enumerate(chain)] + [("abcdefghi8", 3 * 2**9 - 1), ("other", 4)], "word string, n long")
    got = {r.word: r for r in spelling.variants(df).collect()}
    assert all(got[w].form == v and got[w].root == chain[-1] for w, v in zip(chain, chain[1:]))
    assert got[chain[-1]].form is None and got["abcdefghi8"].root == "abcdefghi8" and got["other"].n_near == 0
    assert (got[chain[-1]].n_near, got[chain[-2]].form_n) == (2, 3 * 2**9)


def test_odd_rows(spark, odd_docs, empty_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert told(spelling.digest(odd_docs)) == brute(rows)
    assert spelling.digest(empty_docs).count() == 0
    long = "zyxwvut" * 100_000
    docs = [(1, f"{long} {long} {long} {long[1:]} {long[1:]} {long[1:]} abcde"), (None, "abcde ABCDE Àbcde àbcde"), (None, None), (2, "×abcd ×abcd ×abcd")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert told(spelling.digest(df)) == brute(docs)
