import zlib

import pytest
from pyspark.sql import functions as F

from lumisheet.llm import sharding
from lumisheet.llm.common import table


def check(docs, rows, slack):
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r.doc_id, r.text or "")
    assert len(rows) == docs.count()
    sizes, slots = dict.fromkeys(range(16), 0), {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "bytes") and r.grown_shard is None
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= slack
    return texts


def test_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = sharding.digest(docs).collect()
    mean = docs.selectExpr("avg(octet_length(text))").first()[0]
    texts = check(docs, rows, 4 * mean)
    shards = {}
    for r in rows:
        shards.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) == 0  # no group is cut here


def test_a_group_larger_than_a_shard(spark):
    docs = spark.createDataFrame([(i, "same text " * 5 if i % 3 == 0 else f"text {i} " * 6) for i in range(3000)], "doc_id long, text string")
    rows = sharding.digest(docs).collect()
    check(docs, rows, 250)
    held = [sum(r.shard == s and r.doc_id % 3 == 0 for r in rows) for s in range(16)]
    assert sum(sorted(held)[-7:]) >= 900  # a third of all, in few shards


@pytest.mark.parametrize("shards", [1, 3])
def test_other_counts(spark, shards):
    docs = spark.createDataFrame([(i, "ab" * (i % 7)) for i in range(200)], "doc_id long, text string")
    rows = sharding.shard(docs, shards=shards).collect()
    assert {r.shard for r in rows} == set(range(shards))


def test_odd_rows(odd_docs, empty_docs):
    rows = sharding.digest(odd_docs).collect()
    assert len(rows) == odd_docs.count() and {r.doc_id: (r.size, r.text_crc32) for r in rows}[1] == (1, 0)
    assert sharding.digest(empty_docs).count() == 0


def test_propagation_keeps_links_whole(spark):
    """Links cut by the borders of shards: all groups begin spread out, and few are cut in the end; one group must be."""
    docs = spark.createDataFrame([(i, f"group {i % 150} " * 8 if i % 4 else "hot text " * 6) for i in range(6000)], "doc_id long, text string")
    placed = sharding.digest(docs)
    start = placed.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(16)))
    before, after = (sharding.cut_links(x).first() for x in (start, placed))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for found, rows in ((before, start.collect()), (after, placed.collect())):
        groups = {}
        for r in rows:
            groups.setdefault(texts[r.doc_id], []).append(r.shard)
        assert found.links == sum(len(g) * (len(g) - 1) / 2 for g in groups.values())
        assert found.cut == sum(sum(a != b for b in g[:i]) for g in groups.values() for i, a in enumerate(g))
    own = after.links - 1500 * 1499 / 2
    hot = [r.shard for r in placed.collect() if r.doc_id % 4 == 0]
    hot_cut = (1500 * 1500 - sum(hot.count(s) ** 2 for s in set(hot))) / 2
    assert before.cut > 0.9 * before.links and after.cut < 0.75 * before.cut and after.cut - hot_cut < 0.5 * own
