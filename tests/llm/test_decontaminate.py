import random
import re

import pytest

from lumisheet.llm import decontaminate


def brute(doc, items, window=13):
    w = [x.encode() for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in doc or ""))]
    hit, found = set(), set()
    for item, text in items:
        v = [x.encode() for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())]
        n = min(window, len(v))
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(w), len(hit), found


@pytest.mark.parametrize("seed", range(40))
def test_automaton_against_windows(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcd"[: 2 + seed % 3])
    items = [(str(i), " ".join(word() for _ in range(rng.randint(0, 9)))) for i in range(6)]
    sam = decontaminate.SuffixAutomaton([(i, decontaminate.words(t)) for i, t in items], 5)
    for _ in range(10):
        doc = " ".join(rng.choice([word(), word(), "zz"]) for _ in range(rng.randint(0, 60)))
        spans, found = sam.scan(decontaminate.words(doc))
        n, hit, expected = brute(doc, items, 5)
        assert found == expected and sum(b - a for a, b in spans) == hit
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("max_block_words", [200_000, 40])
def test_blocks_and_odd_rows(spark, odd_docs, max_block_words):
    items = [(1, "the cat sat on the mat with the OTHER cat and all the dogs today"), (2, "table avec le chien"), (3, None), (None, "12345"), (5, ""), (2, "table avec le chien")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(odd_docs, bench, max_block_words=max_block_words)
    rows = {(r.doc_id, r.text): r for r in got.collect()}
    named = [(str(i) if i is not None else "", t) for i, t in items]
    for (_, text), r in rows.items():
        n, hit, found = brute(text, named)
        assert (r.n_words, r.n_hit, r.hit_items) == (n, hit, sorted(found))
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
    assert got.count() == odd_docs.count() and rows[5, rows_text(odd_docs, 5)].contaminated
    kept = decontaminate.drop_contaminated(odd_docs, bench, max_block_words=max_block_words)
    assert kept.columns == odd_docs.columns and {r.n_words for r in kept.collect()} == {"z"}
    clean = decontaminate.remove_spans(odd_docs, bench, min_words=4)
    assert clean.where("doc_id = 5").first().text == "Le chat est sur la  et les oiseaux."


def test_long_items_and_hot_ids_are_cut_into_blocks(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    texts = [" ".join(word() for _ in range(n)) for n in (500, 300, 200, 30, 5)]
    bench = spark.createDataFrame([(1, t) for t in texts] + [(1, texts[0])], "item_id long, text string")
    blocks = list(decontaminate._blocks(bench, "item_id", "text", 13, 100))
    assert len(blocks) > 8 and all(sum(len(w) for _, w in b) <= 112 for b in blocks)
    ws = texts[0].split()
    docs = spark.createDataFrame([(0, " ".join(["x", *ws[93:120], "y"])), (1, texts[1]), (2, f"x {texts[4]} y"), (3, "x " * 50)], "doc_id long, text string")
    for at_once in (1, 100):
        got = {r.doc_id: r for r in decontaminate.contaminated(docs, bench, max_block_words=100, blocks_at_once=at_once).collect()}
        for i, text in ((r.doc_id, r.text) for r in docs.collect()):
            n, hit, found = brute(text, [("1", t) for t in texts])
            assert (got[i].n_words, got[i].n_hit, set(got[i].hit_items)) == (n, hit, found)


def rows_text(docs, key):
    return docs.where(f"doc_id = {key}").first().text


def test_empty_tables(spark, odd_docs, empty_docs):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.digest(empty_docs, bench).count() == 0
    got = decontaminate.digest(odd_docs, bench.where("1 = 0")).collect()
    assert len(got) == odd_docs.count() and not any(r.contaminated or r.n_hit for r in got)
    assert {r.items_sha256 for r in got} == {decontaminate.items_sha256([])}
