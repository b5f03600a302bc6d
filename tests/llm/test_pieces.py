import random

import pytest
import sentencepiece

from lumisheet.llm import pieces
from lumisheet.llm.common import table


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(pieces.load())


def encode(vocabulary, texts, cache=1000):
    tokens, n = vocabulary.encode(texts, cache)
    out, at = [], 0
    for k in n.tolist():
        out.append(tokens[at : at + k].tolist())
        at += k
    return out


def test_random_texts(vocabulary, model):
    rng = random.Random(7)
    names = list(vocabulary.ids)
    letters = "abcdefghijklmnopqrstuvwxyzABC    éüñ日本.,-12\n\t\r😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 150))) for _ in range(300)]
    texts += ["".join(rng.choice(names) for _ in range(rng.randint(1, 30))).replace(pieces.SPACE, " ") for _ in range(500)]
    texts += ["", " ", "  ", " " * 100 + "x", "x" * 3000, "\x00", "ab" * 70 + " " * 17, "don't", "日本語" * 400, "<s> </s> <unk> <0x0A>"]
    assert encode(vocabulary, texts) == model.encode(texts)
    assert encode(vocabulary, texts, 5) == model.encode(texts)  # a cache that is full at once
    assert [vocabulary.decode(t) for t in model.encode(texts)] == texts


def test_merging_by_hand_agrees(vocabulary, model):
    for word in ("▁hello", "▁internationalization", "▁▁▁", "x"):
        assert vocabulary.merge(word)[0] == model.encode(word.replace(pieces.SPACE, " ")[1:] if word[0] == pieces.SPACE else "\n" + word)[-len(vocabulary.merge(word)[0]) :]


def test_documents(spark, sf_dir, model):
    docs = table(spark, sf_dir, "documents")
    rows = pieces.digest(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert [r.ids for r in rows] == model.encode([r.text for r in rows])
    assert all(r.exact and r.n_tokens == len(r.ids) for r in rows)
    back = pieces.decode(pieces.digest(docs)).join(docs.select("doc_id", "text").withColumnRenamed("text", "was"), "doc_id")
    assert back.where("text <> was").count() == 0 and back.count() == docs.count()


def test_odd_rows(odd_docs, empty_docs):
    rows = pieces.digest(odd_docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == odd_docs.count() and all(r.exact for r in rows) and by[1].ids == by[2].ids == [] and by[7].n_tokens > 10_000
    assert pieces.digest(empty_docs).count() == 0 and pieces.encoded(odd_docs).count() == odd_docs.count()


def test_text_without_spaces_is_cut_where_no_piece_crosses():
    import time

    text = "".join(chr(0x4E00 + k * 7 % 2000) for k in range(60_000)) + "日本語のテキスト" * 2000
    vocabulary = pieces._vocabulary(tuple(pieces.load()))
    vocabulary.clear()
    began = time.perf_counter()
    tokens, n = vocabulary.encode([text], 10)
    assert time.perf_counter() - began < 4
    assert tokens.tolist() == sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).encode(text) and n.tolist() == [len(tokens)]


def test_memory_stays_flat_over_long_chunks(model):
    vocabulary, rng = pieces.Vocabulary(pieces.load()), random.Random(3)
    fresh = lambda: ["".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(2000)) for _ in range(10)]
    for _ in range(30):
        texts = [*fresh(), "a few plain words"]
        assert encode(vocabulary, texts, 1000)[-1] == model.encode(texts[-1])
        assert len(vocabulary.store) < 1100 and len(vocabulary.cache) < 1100 and len(vocabulary.first) == len(vocabulary.count) == len(vocabulary.cache)
    assert encode(vocabulary, fresh() + ["word " * 30] + [" " * 80 + "x"]) and sum(map(len, vocabulary.cache)) < 1000
