import pytest
from pyspark.sql import Row

LONG = "lorem ipsum dolor sit amet consectetur " * 4000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [
        (0, "The cat sat on the mat with the other cat and all the dogs.", "en", "s0"),
        (1, None, "en", "s1"),
        (2, "", "fr", None),
        (3, " \t\n", None, "s1"),
        (4, "12345 !!! ???", "en", "s2"),
        (5, "Le chat est sur la table avec le chien et les oiseaux.", "fr", "s2"),
        (6, "The cat sat on the mat with the other cat and all the dogs.", "en", "s0"),
        (6, "The cat sat on the mat with the other cat and all the dogs.", "en", "s0"),
        (7, LONG, "la", "s3"),
        (8, LONG, "la", "s3"),
        (9, "日本語 😀 ünïcödé Straße ﬁ \x00 a@b.co", "xx", "s4"),
        (None, "no id here", "en", "s5"),
    ]
    names = ["doc_id", "text", "lang", "source"]
    extra = dict(fp=1, lang_pred="x", score="y", pii=2, n_words="z", hit_spans=3, hit_items=4, component_id=5, id="i", label=6, slot=7, ids=8, exact=9, kept=10, _v=11, size="12", g="g", n_hit=1, n_chars=3)
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{k} {'string' if isinstance(v, str) else 'int'}" for k, v in extra.items())
    return spark.createDataFrame([Row(**dict(zip(names, r, strict=True)), **extra) for r in rows], schema)


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.where("1 = 0")
