import pytest
import numpy as np

from lumisheet.llm import langid
from lumisheet.llm.common import table


def brute_vector(text, dims, seed):
    first, second, third = langid._letters(dims, seed)
    s = [langid._class_of(ord(c)) if c.isalpha() else 0 for c in text.lower()]
    s = [0, *[x for i, x in enumerate(s + [0]) if x or (i and (s + [0])[i - 1])]]
    v = np.zeros(dims)
    for a, b, c in zip(s, s[1:], s[2:], strict=False):
        v += first[a].astype(float) * second[b] * third[c]
    return v


def test_bundles_against_single_trigrams():
    texts = ["Hello wörld", "  a", "", "1 2", "été à la plage, ça va?", "日本語 😀x", "x", "aaaa " * 3000]
    got = dict(langid._bundles(texts, 64, 1))
    for i, t in enumerate(texts):
        if any(c.isalpha() for c in t):
            assert np.array_equal(got[i], brute_vector(t, 64, 1)), t
        else:
            assert i not in got


def test_held_out_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    both = langid.digest(docs).where("held_out").join(docs, "doc_id").selectExpr("avg(cast(lang = lang_pred as int)) as a").first()
    assert both.a > 0.97


def test_partitioning_does_not_matter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(60)
    a, b = langid.learn(docs.repartition(1)), langid.learn(docs.repartition(7))
    assert a.keys() == b.keys() and all(np.array_equal(a[k], b[k]) for k in a)


def test_odd_rows(odd_docs, empty_docs):
    rows = langid.digest(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert all((by[k].lang_pred, by[k].score) == ("und", 0.0) for k in (1, 2, 3, 4))
    assert by[0].lang_pred != "und" and all(0 <= r.score <= 1 for r in rows)
    assert by[None].held_out is False
    kept = langid.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 5, 6, 6, 7, 8, 9]
    assert {r.score for r in kept.collect()} == {"y"}
    assert langid.digest(empty_docs).count() == 0
    assert {r.lang_pred for r in langid.predict(odd_docs.select("doc_id", "text"), {}).collect()} == {"und"}


#: Sentences to learn from and sentences to tell, of languages that share a script or a block of code points.
SCRIPTS = {
    "ar": (["ذهب الولد إلى المدرسة في الصباح وكان الجو جميلا", "هذا الكتاب الذي قرأته في المكتبة العامة مفيد جدا", "تقع المدينة على البحر ويعيش فيها كثير من الناس", "سوف نسافر إلى القاهرة في الأسبوع القادم مع العائلة"], ["قرأت الطالبة الكتاب في المكتبة", "الناس في المدينة يحبون البحر"]),
    "fa": (["من هر روز صبح به مدرسه می‌روم و با دوستانم درس می‌خوانم", "این کتاب را که از کتابخانه گرفته‌ام خیلی خوب است", "شهر ما در کنار دریا است و مردم زیادی در آن زندگی می‌کنند", "هفته آینده با خانواده به تهران سفر خواهیم کرد"], ["دوستانم این کتاب را می‌خوانند", "مردم شهر در کنار دریا زندگی می‌کنند"]),
    "ja": (["わたしはまいにちがっこうへいきます", "この本はとてもおもしろかったです", "町のちかくに海があって、たくさんの人がすんでいます", "来週かぞくといっしょに東京へ行くつもりです"], ["ともだちはがっこうで本をよんでいます", "海のちかくにすんでいる人がいます"]),
    "ru": (["мальчик пошёл утром в школу, и погода была хорошая", "эта книга, которую я взял в библиотеке, очень интересная", "город стоит на берегу моря, и в нём живёт много людей", "на следующей неделе мы поедем всей семьёй в столицу"], ["девочка взяла в библиотеке интересную книгу", "люди живут на берегу моря, погода хорошая"]),
    "th": (["ฉันไปโรงเรียนทุกวันตอนเช้ากับเพื่อน", "หนังสือเล่มนี้ที่ยืมมาจากห้องสมุดสนุกมาก", "เมืองของเราอยู่ริมทะเลและมีคนอาศัยอยู่มากมาย", "สัปดาห์หน้าเราจะเดินทางไปกรุงเทพกับครอบครัว"], ["เพื่อนอ่านหนังสือที่ห้องสมุด", "คนในเมืองอาศัยอยู่ริมทะเล"]),
    "uk": (["хлопець пішов уранці до школи, і погода була гарна", "ця книжка, яку я взяв у бібліотеці, дуже цікава", "місто стоїть на березі моря, і в ньому живе багато людей", "наступного тижня ми поїдемо всією родиною до столиці"], ["дівчина взяла в бібліотеці цікаву книжку", "люди живуть на березі моря, погода гарна"]),
}


def test_scripts_beyond_latin(spark):
    train = spark.createDataFrame([(t, lang) for lang, (texts, _) in SCRIPTS.items() for t in texts], "text string, lang string")
    asked = spark.createDataFrame([(t, lang) for lang, (_, texts) in SCRIPTS.items() for t in texts], "text string, lang string")
    assert [(r.lang, r.text) for r in langid.predict(asked, langid.learn(train)).collect() if r.lang_pred != r.lang] == []


def test_letters_have_their_own_vectors():
    letters = [0, *map(ord, "azéßłžğжіїعپกあ한अ中"), 0x20000]
    rows = np.stack([langid._letters(1024, 1)[2][x] for x in letters]).astype(int)
    assert set(np.unique(rows)) == {-1, 1}
    assert np.abs(rows @ rows.T - 1024 * np.eye(len(letters), dtype=int)).max() < 200


def test_large_alphabets_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FA0, 700))) for _ in range(6)]
    docs = spark.createDataFrame([(t, "zh" if i % 2 else "yue") for i, t in enumerate(texts)], "text string, lang string")
    expected = {lang: sum(brute_vector(t, 1024, 1) for i, t in enumerate(texts) if (i % 2 == 1) == (lang == "zh")) for lang in ("zh", "yue")}
    monkeypatch.setattr(langid, "BOUND", 10)
    got = langid.learn(docs.repartition(1), held_grams=100)
    assert got.keys() == expected.keys() and all(np.array_equal(got[k], expected[k]) for k in expected)
    assert all(np.array_equal(v, brute_vector(texts[i], 1024, 1)) for i, v in langid._bundles(texts, 1024, 1))


@pytest.mark.parametrize("chars", [1, 2, 7, 1000])
def test_long_texts_in_slices(chars):
    for text in ("", "a", "  ab c,d  Éf? 日本 x1y", "word " * 50 + "ΑΣ ΣΑ", "12 34"):
        whole, _ = langid.trigrams([text])
        sliced = [c for part in langid.long_trigrams(text, chars) for c in part.tolist()]
        assert sliced == whole.tolist()


def test_long_texts_teach_and_are_judged_alike(spark, monkeypatch):
    rows = [(1, "the cat sat on the mat and the dogs " * 30, "en"), (2, "le chat est sur la table avec les oiseaux " * 30, "fr"), (5, "the dogs and the cat", None), (7, "12 " * 900, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    model = langid.learn(docs)
    plain = [tuple(r) for r in langid.predict(docs, model).orderBy("doc_id").collect()]
    monkeypatch.setattr(langid, "SLICE_CHARS", 100)
    batch = [t for _, t, _ in rows]
    assert list(langid._slices(batch, 100)) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    for text in batch:
        short, long_ = (dict(langid._bundles([text], 1024, 1)) for _ in range(2))
        assert short.keys() == long_.keys() and len(plain) == 4
    v = dict(langid._bundles([batch[0]], 1024, 1))[0]
    monkeypatch.setattr(langid, "SLICE_CHARS", 1 << 20)
    assert (v == dict(langid._bundles([batch[0]], 1024, 1))[0]).all()
