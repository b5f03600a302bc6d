import numpy as np
import pytest

from lumisheet.llm import quality
from lumisheet.llm.common import table


def small_net(seed=1):
    rng = np.random.default_rng(seed)
    net = quality.Network(width=6, stride=4, span=3)
    net.weights = quality._start(6, 3, 5, 4, rng)
    net.weights["bias"] += rng.normal(size=5).astype(np.float32)
    return net


def brute_pooled(net, text):
    """The three pools, window by window."""
    w, n = net.weights, max(1, -(-(len(text) - net.width) // net.stride) + 1)
    data = bytes(text) + bytes(net.width + net.stride)
    h = np.array([np.maximum(np.concatenate([w["bytes"][b] for b in data[i * net.stride : i * net.stride + net.width]]) @ w["filters"] + w["bias"], 0) for i in range(n)])
    spans = [h[i : i + net.span] for i in range(0, n, net.span)]
    strips = [np.concatenate(p) for p in zip(spans, spans[1:])] or spans
    means = np.array([s.mean(axis=0) for s in strips])
    return np.concatenate((h.max(axis=0), means.max(axis=0), means.min(axis=0)))


def test_pools_cover_whole_texts():
    net, rng = small_net(), np.random.default_rng(2)
    texts = [rng.integers(0, 256, n).astype(np.uint8) for n in [0, 1, 5, 6, 7, 9, 10, 11, *range(12, 60, 3), 500, 3001]]
    want = np.array([brute_pooled(net, t) for t in texts])
    for chunk, block in ((1, 1), (40, 20), (1 << 16, 1 << 14)):
        assert np.allclose(quality.pooled(net, texts, chunk, block), want, atol=1e-4)


def test_gradients_against_differences():
    net, rng = small_net(3), np.random.default_rng(4)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    texts, y = [rng.integers(0, 256, n).astype(np.uint8) for n in (3, 40, 90)], np.array([0, 1, 1.0])
    drop = np.ones((3, 15))

    def loss():
        p = quality._probability(net, np.array([brute_pooled(net, t) for t in texts]))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = quality._gradients(net, texts, y, drop)
    for k, v in net.weights.items():
        places = np.argwhere(np.abs(g[k]) > 1e-3)
        assert len(places), k
        for at in map(tuple, places[:: max(1, len(places) // 8)]):
            v[at] += 1e-5
            up = loss()
            v[at] -= 2e-5
            assert (up - loss()) / 2e-5 == pytest.approx(g[k][at], rel=0.02, abs=1e-4), (k, at)
            v[at] += 1e-5


def test_held_out_accuracy(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    both = quality.digest(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    by = {k: [r.predicted == k for r in both if r.quality == k] for k in (0, 1)}
    assert np.mean(by[1]) > 0.97 and np.mean(by[0]) > 0.85, {k: (len(v), np.mean(v)) for k, v in by.items()}


def test_junk_counts_wherever_it_stands(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    net = quality.fit(docs, labels)
    good = max((r.text for r in docs.join(labels.where("quality = 1 and toxic = 0"), "doc_id").collect()), key=len)
    junk = " ".join(["ononer | thheti | anding | whblean |"] * 30)
    texts = [good, good + " " + junk, junk + " " + good, good[:2000] + " " + junk + " " + good[2000:], good * 40, good * 40 + junk + good * 40]
    p = quality.scores(net, [np.frombuffer(t.encode(), np.uint8) for t in texts])
    z = np.log(p / (1 - p))
    assert p[0] > 0.5 and p[4] > 0.5 and all(z[k] < z[0] - 2 for k in (1, 2, 3)) and z[5] < z[4] - 2, z


def test_odd_rows(spark, odd_docs, empty_docs):
    labels = spark.createDataFrame([(0, 1, 0), (5, 0, None), (7, 1, 0), (6, 0, 1), (6, 1, 1), (9, None, 1), (2, 1, 1), (1, 0, 1), (99, 0, 0), (None, 1, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    rows = quality.digest(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1 == len({r.score for r in rows if r.doc_id in (7, 8)})
    assert {r.score for r in quality.digest(odd_docs, labels.where("1 = 0")).collect()} == {0.5}
    assert {r.score for r in quality.digest(odd_docs, labels.where("quality = 0")).collect()} == {0.0}
    assert quality.digest(empty_docs, labels).count() == 0
    kept = quality.scored(odd_docs, small_net())
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
