import numpy as np
import pytest

from lumisheet.llm import whitening
from lumisheet.llm.common import table


def brute(rows):
    """n, x-vectors, sums, covariance in exact integers first, then double."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in r] for r in rows], object)
    n, s = len(x), x.sum(axis=0)
    away = n * x - s
    d = away.astype(float) / n
    return n, x, s, (away**2).sum(axis=1), d, d.T @ d / n


def test_table_against_brute_force(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    kept = [r for r in vectors.select("vec_id", "embedding").collect() if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]
    n, _, _, dev, d, v = brute([r.embedding for r in kept])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    rows = whitening.digest(vectors).collect()
    assert len(rows) == 32 * n
    by = {(r.vec_id, r.component): r for r in rows}
    at = {r.vec_id: i for i, r in enumerate(kept)}
    for k in range(1, 33):
        want = d @ u[:, k - 1] / np.sqrt(e[k - 1])
        got = np.array([by[r.vec_id, k].whitened for r in kept])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-7
        assert by[kept[0].vec_id, k].explained == pytest.approx(e[k - 1] / np.trace(v), rel=1e-9)
    assert all(r.n == n and r.deviation == dev[at[r.vec_id]] and r.identity_error < 1e-8 for r in rows)


def test_partitioning_does_not_matter(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    a, b = whitening.fit(vectors.repartition(1)), whitening.fit(vectors.repartition(9))
    assert (a.n, a.sums) == (b.n, b.sums) and np.allclose(a.values, b.values, rtol=1e-12) and np.allclose(a.vectors, b.vectors, atol=1e-8)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=3)]) for i in range(40)]
    rows += [(100, None), (101, [1.0, None, 2.0]), (102, [nan, 0.0, 0.0]), (103, [inf, 0.0, 0.0]), (104, [-inf, 0.0, 0.0])]
    rows += [(105, []), (106, [0.5]), (None, [0.1, 0.2, 0.3]), (7, rows[7][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(*r, i % 2, "x") for i, r in enumerate(rows)], "vec_id long, embedding array<double>, whitened int, deviation string").repartition(5)
    got = whitening.digest(df).collect()
    clean = [(i, v + [0.0] * (3 - len(v))) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    n, _, _, dev, _, _ = brute([v for _, v in clean])
    assert len(got) == 3 * n and {r.n for r in got} == {n} and all(r.identity_error < 1e-9 for r in got)
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(dev)
    assert sum(r.vec_id == 7 for r in got) == 9 and sum(r.vec_id is None for r in got) == 3
    assert whitening.digest(df.where("1 = 0")).count() == 0 == whitening.digest(df.where("vec_id = 105")).count()


def test_dimensions_without_spread_have_no_component(spark):
    rows = [(i, [float(i % 5), 2.0 * (i % 5), 1.0, float(i % 3)]) for i in range(30)]
    got = whitening.digest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.component for r in got} == {1, 2} and all(r.identity_error < 1e-9 for r in got)
    assert sum({r.component: r.explained for r in got}.values()) == pytest.approx(1)
    assert whitening.digest(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")).count() == 0


def test_large_numbers_stay_exact():
    big = np.array([[1e300, -1e300, 3.0], [1e9, 5.0, -2.5]])
    import pyarrow as pa

    x = whitening.whole(pa.array(big.tolist(), pa.list_(pa.float64())))
    assert x[0].tolist() == [2**44 + 10**6, 10**6 - 2**44, 10**6 + 192]
    n, sums = 10**7, tuple(int(v) for v in x.sum(axis=0))
    away = whitening.centred(x, n, sums)
    assert away[1].tolist() == [n * int(x[1, j]) - sums[j] for j in range(3)]
    assert whitening.deviations(away) == [None, None]
    small = np.array([[3, 4], [2**31, 2**31], [2**32, 0]], np.int64)
    assert whitening.deviations(small) == [25, None, None]
