"""Grain, ranks, tone curves, hue bands, as-of and range joins, pyramids: values, odd rows and plans."""

import datetime as dt
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumisheet.errors import ShapeError
from lumisheet.operators import ToneCurve, asof_join, band_sums, brightest, equalize, film_grain, hsl_bw, luminance_bw, percent_ranks, range_join, tile_pyramid, tone_curve
from lumisheet.operators.ranks import radix
from lumisheet.queries import QUERIES
from lumisheet.sources import constant_image, events_image, from_numpy, to_numpy

NAN, INF = float("nan"), float("inf")


def plan_of(df):
    """The first plan that would run, before adaptive execution changes it."""
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def nodes(df, name):
    return len(re.findall(rf"(?<![A-Za-z]){name}(?![A-Za-z])", plan_of(df)))


def pixels(spark, values, image_id=0):
    return spark.createDataFrame([(image_id, i // 10, i % 10, v) for i, v in enumerate(values)], "image_id long, y int, x int, l float")


# grain
@pytest.mark.parametrize("size", [1, 4])
def test_grain_is_gaussian_and_correlated_by_size(spark, size):
    g = (to_numpy(film_grain(constant_image(spark, 160, 160, l=0.5), 0.1, 11, size), "l")[..., 0].astype(float) - 0.5) / 0.1
    assert abs(g.mean()) < 0.06 * size and abs(g.var() - 1) < 0.03 * size**2
    assert abs((g**3).mean()) < 0.1 * size and abs((g**4).mean() - 3) < 0.3 * size
    near, far = (np.mean(g[:, d:] * g[:, :-d]) for d in (1, 2 * size))
    assert abs(far) < 0.03 * size and (near > 0.6 if size > 1 else abs(near) < 0.03)


def test_grain_depends_on_seed_and_place_alone(spark):
    image = constant_image(spark, 30, 40, l=0.4)
    one = to_numpy(film_grain(image, 0.2, 5, 3), "l")
    assert np.array_equal(one, to_numpy(film_grain(image.repartition(7, "x"), 0.2, 5, 3), "l"))
    cut = film_grain(image.where("y >= 10 and x < 9"), 0.2, 5, 3).orderBy("y", "x").collect()
    assert [r.l for r in cut] == one[10:, :9, 0].ravel().tolist()
    for other in (film_grain(image, 0.2, 6, 3), film_grain(image, 0.2, 5 + 2**32, 3), film_grain(constant_image(spark, 30, 40, 2**40, l=0.4), 0.2, 5, 3)):
        assert abs(np.corrcoef(one.ravel(), to_numpy(other, "l").ravel())[0, 1]) < 0.3


def test_grain_of_odd_pixels_and_its_plan(spark):
    got = [r.l for r in film_grain(pixels(spark, [0.0, 1.0, -2.0, 3.0, None, NAN]), 0.5, 1).orderBy("x").collect()]
    assert got[:5] == [0.0, 1.0, -2.0, 3.0, None] and math.isnan(got[5])
    grained = film_grain(constant_image(spark, 9, 9, l=0.5), 0.1, 1, 2)
    assert nodes(grained, "Exchange") == 0 and "Python" not in plan_of(grained) and grained.columns == ["image_id", "y", "x", "l"]
    assert grained.where("1 = 0").count() == 0
    with pytest.raises(ShapeError):
        film_grain(pixels(spark, [0.5]), 0.1, 1, 0)


# ranks
def test_radix_never_falls(spark):
    rng = np.random.default_rng(1)
    with np.errstate(all="ignore"):
        v = rng.integers(0, 2**32, 20_000, dtype=np.uint64).astype(np.uint32).view(np.float32)
    powers = np.float32(2.0) ** np.arange(-149, 128, dtype=np.float32)
    v = np.concatenate((v[~np.isnan(v)], powers, np.nextafter(powers, np.float32(0)), -powers, np.float32([0, INF, -INF]), rng.normal(size=2000).astype(np.float32)))
    v = np.unique(v)
    got = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(v)), "l": v})).select("i", radix(F.col("l").cast("float")).alias("k")).orderBy("i").toPandas().k.to_numpy()
    assert (np.diff(got) >= 0).all() and len(np.unique(got)) > 5000
    exponents = radix(F.col("l").cast("float"))
    dense = np.arange(0x3F000000, 0x3F000000 + 3 * 65536, 997, dtype=np.uint32).view(np.float32)  # 65,536 numbers share a bucket
    assert len({r.k for r in spark.createDataFrame(pd.DataFrame({"l": dense})).select(exponents.alias("k")).collect()}) == 3


def test_percent_ranks_against_sorting(spark):
    rng = random.Random(3)
    values = [rng.choice([0.0, -0.0, 0.5, 0.25, 1e-40, -1e-40, -3.0, INF, -INF, NAN, None, rng.random(), 1.0 + rng.randint(0, 9) * 2**-23]) for _ in range(600)]
    df = pixels(spark, values).union(pixels(spark, [0.3], 1)).union(pixels(spark, [None], 2))
    f32 = [None if v is None else float(np.float32(v)) for v in values]
    known = [(math.isnan(v), 0 if math.isnan(v) else v) for v in f32 if v is not None]
    got = {(r.image_id, r.y * 10 + r.x): r["rank"] for r in percent_ranks(df).collect()}
    assert len(got) == 602 and got[1, 0] == 0.0 and got[2, 0] is None
    for i, v in enumerate(f32):
        want = None if v is None else sum(k < (math.isnan(v), 0 if math.isnan(v) else v) for k in known) / (len(known) - 1)
        assert got[0, i] == pytest.approx(want), (i, v)


def test_ranks_without_one_task_for_an_image(spark):
    df = pixels(spark, [0.5] * 300 + [i / 100 for i in range(100)])
    ranked = percent_ranks(df)
    assert "SinglePartition" not in plan_of(ranked.select("rank")).replace("TakeOrdered", "") and "Window" in plan_of(ranked)
    assert "NestedLoop" not in plan_of(ranked) and "Cartesian" not in plan_of(ranked)
    assert equalize(df).columns == df.columns and equalize(df.where("1 = 0")).count() == 0
    flat = equalize(pixels(spark, [float(v) for v in range(11)]), 1.0, 2.0)
    assert [r.l for r in flat.orderBy("y", "x").collect()] == pytest.approx([0.2 * v for v in range(11)])


# tone curve
def test_curve_stays_between_its_knots(spark):
    rng = random.Random(4)
    grid = np.linspace(-0.2, 1.2, 2001, dtype=np.float32)
    image = from_numpy(spark, grid.reshape(1, -1, 1))
    for _ in range(6):
        n = rng.randint(2, 40)
        knots = list(zip(sorted(rng.random() for _ in range(n)), sorted(rng.choice([rng.random(), 0.5]) for _ in range(n))))
        out = to_numpy(tone_curve(image, ToneCurve(tuple(knots))), "l").ravel()
        assert (np.diff(out) >= -1e-6).all() and out.min() >= knots[0][1] - 1e-6 and out.max() <= knots[-1][1] + 1e-6
        at = [int(np.abs(grid - x).argmin()) for x, _ in knots]
        assert np.abs(out[at] - [y for _, y in knots]).max() < 0.2
    exact = from_numpy(spark, np.float32([0.0, 0.25, 0.5, 1.0]).reshape(1, -1, 1))
    assert to_numpy(tone_curve(exact, ToneCurve(((0, 0), (0.25, 0.5), (0.5, 0.6), (1, 1)))), "l").ravel() == pytest.approx([0, 0.5, 0.6, 1])
    assert to_numpy(tone_curve(exact, ToneCurve(((0, 1), (1, 3)))), "l").ravel() == pytest.approx([1, 1.5, 2, 3])


def test_curve_of_odd_knots_and_pixels(spark):
    df = pixels(spark, [0.5, None, NAN, -INF, INF])
    assert tone_curve(df, ToneCurve(())) is df
    got = [r.l for r in tone_curve(df, ToneCurve(((0.2, 0.1), (0.8, 0.7)))).orderBy("x").collect()]
    assert got[0] == pytest.approx(0.4) and got[1] is None and math.isnan(got[2]) and got[3:] == pytest.approx([0.1, 0.7])
    assert [r.l for r in tone_curve(df, ToneCurve(((0.3, 0.6),))).where("x in (0, 3)").collect()] == pytest.approx([0.6, 0.6])
    for bad in (((0, 0), (0, 1)), tuple((i, i) for i in range(65))):
        with pytest.raises(ShapeError):
            ToneCurve(bad)
    table = spark.createDataFrame([(1, 2), (0, 1)], "x int, y int")
    assert ToneCurve.from_table(table).knots == ((0.0, 1.0), (1.0, 2.0))
    curved = tone_curve(df, ToneCurve(tuple((i / 63, i / 63) for i in range(64))))
    assert nodes(curved, "Exchange") == 0 and "Python" not in plan_of(curved)


# hue bands
def test_hue_bands(spark):
    stops = [1.0, 0.5, 0.25, 0.0, -0.5, -1.0, -0.25, 0.75]
    rgb = np.float32([[[1, 0, 0], [1, 1e-4, 0], [1, 0, 1e-4], [0.3, 0.3, 0.3], [0, 0, 0], [1, 1, 1], [0, 1, 1], [2.0, 2.0, -1]]])
    image = from_numpy(spark, rgb)
    out, plain = to_numpy(hsl_bw(image, stops), "l").ravel(), to_numpy(luminance_bw(image), "l").ravel()
    assert out[0] == pytest.approx(2 * plain[0]) and out[1] == pytest.approx(out[0], rel=1e-3) and out[2] == pytest.approx(out[0], rel=1e-3)
    assert out[3:6].tolist() == plain[3:6].tolist() and out[6] == pytest.approx(plain[6] * 2**-0.5)
    assert out[7] == pytest.approx(plain[7] * 2 ** (0.5 + (0.25 - 0.5) / 3))  # 60 degrees, a third of the way from 45 to 90
    assert to_numpy(hsl_bw(image, [0.0] * 8), "l").ravel() == pytest.approx(plain)
    assert nodes(hsl_bw(image, stops), "Exchange") == 0
    with pytest.raises(ShapeError):
        hsl_bw(image, stops[:7])


# as-of join
def moment(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_asof_against_all_pairs(spark, kind):
    rng = random.Random(6)
    pick = lambda: None if rng.random() < 0.05 else rng.randint(-500, 3000)
    key = lambda: rng.choice(["a", "a", "a", "b", "c", None])
    left = [(i, key(), pick()) for i in range(400)]
    right = [(key(), pick(), rng.choice([None, rng.randint(0, 5)])) for _ in range(150)]
    stamp = lambda s: None if s is None else moment(s)
    a = spark.createDataFrame([(i, k, stamp(s), 1) for i, k, s in left], f"id int, key string, ts {kind}, v int")
    b = spark.createDataFrame([(k, stamp(s), v) for k, s, v in right], f"key string, ts {kind}, v int")
    got = {r.id: (r.v, r.v_ts) for r in asof_join(a, b, "key", "ts", "v", 300).collect()}
    assert len(got) == len(left)
    for i, k, s in left:
        fits = [(t, v is not None, v) for q, t, v in right if q == k and k is not None and t is not None and s is not None and t <= s]
        best = max(fits, key=lambda f: (f[0], f[1], f[2] or 0), default=None)
        assert got[i] == ((None, None) if best is None else (best[2], moment(best[0]))), (i, k, s)


def test_asof_of_a_hot_key(spark):
    """Half of the rows have one key: its buckets are apart, and what meets by key is a row for each bucket."""
    left = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 100).alias("key"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    right = left.where("id % 50 = 0").select("key", "ts", F.col("id").alias("v"))
    out = asof_join(left, right, "key", "ts", "v", 3600)
    parts = re.findall(r"hashpartitioning\(([^)]*)\)", plan_of(out))
    assert parts and all("_bucket" in p or "_key" in p for p in parts) and "Join" not in plan_of(out)
    assert out.where("key = 0 and id >= 50 and v != floor(id / 50) * 50 and v is not null").count() == 0
    spread = out.where("key = 0").groupBy(F.floor(F.unix_seconds("ts") / 3600)).count().agg(F.max("count")).first()[0]
    assert spread <= 60 and out.count() == 20_000


# range join
def test_range_join_against_all_pairs(spark):
    rng = random.Random(7)
    values = [rng.choice([rng.uniform(-2, 2), rng.uniform(-1e6, 1e6), 0.0, 0.5, 1e30, INF, -INF, NAN, None]) for _ in range(300)]
    bands = [(k, lo, lo + rng.choice([0, -1, 0.001, 0.5, 40.0, 1e5, 1e9])) for k in range(60) for lo in [rng.choice([0.5, 0.0, rng.uniform(-3, 3)])]]
    bands += [(60, None, 0.5), (61, 0.5, None), (62, -INF, INF), (63, None, None), (64, 0.5, 0.5), (65, 1e29, 1e31), (66, NAN, 1.0), (67, 0.0, NAN)]
    points = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    table = spark.createDataFrame(bands, "band int, low double, high double")
    got = range_join(points, "v", table, "low", "high", 0.01)
    assert got.columns == ["id", "v", "band", "low", "high"]
    top = lambda x: (1, 0) if isinstance(x, float) and math.isnan(x) else (0, x)  # noqa: E731  NaN is the largest number
    want = sorted((i, k) for i, v in enumerate(values) if v is not None and not math.isnan(v) for k, lo, hi in bands if top(-INF if lo is None else lo) <= top(v) < top(INF if hi is None else hi))
    assert sorted((r.id, r.band) for r in got.collect()) == want
    assert range_join(points, "v", table.where("1 = 0"), "low", "high", 0.01).count() == 0


def test_range_join_plan(spark, sf_dir):
    points = events_image(spark, sf_dir)
    bands = points.select(F.col("x").alias("band"), F.col("l").alias("low"), (F.col("l") + 1).alias("high"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        shuffled = plan_of(range_join(points, "l", bands, "low", "high", 0.1))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for plan in (shuffled, plan_of(range_join(points, "l", bands, "low", "high", 0.1))):
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "SortMergeJoin" in shuffled


# sums of bands
def test_band_sums_against_all_pairs(spark):
    rng = random.Random(8)
    edges = [0.0, -0.0, 0.5, 1.0, -1.0, 1e-45, -1e-45, 2.0**-126, 3.4028234663852886e38, -3.4028234663852886e38]
    values = [rng.choice([rng.uniform(-2, 2), rng.uniform(-1e6, 1e6), *edges, -1e30, INF, -INF, NAN, None]) for _ in range(400)]
    f32 = [None if v is None else float(np.float32(v)) for v in values]
    near = lambda: rng.choice([rng.choice([v for v in f32 if v is not None]) * rng.choice([1, 1, 1 - 1e-12, 1 + 1e-9]), rng.uniform(-3, 3), rng.choice(edges), 1e-60, -1e-60, 1e39, -1e39, 1e300, INF, -INF, NAN, None])
    bands = [(k, near(), near()) for k in range(400)] + [(400, 0.5, 0.5), (401, None, None), (402, 1.0 - 1e-12, 1.0), (403, -1.0 + 1e-12, -0.99999994), (404, -1.0 + 1e-12, -0.9999999)]
    points = spark.createDataFrame([(v,) for v in [*values, -0.99999994]], "l float")
    got = {r.band: (r.n, r.total) for r in band_sums(points, "l", spark.createDataFrame(bands, "band int, low double, high double"), "low", "high").collect()}
    assert len(got) == len(bands)
    top = lambda x: (1, 0) if math.isnan(x) else (0, x)  # noqa: E731  NaN is the largest number
    known = [v for v in [*f32, float(np.float32(-0.99999994))] if v is not None and not math.isnan(v)]
    for k, low, high in bands:
        held = [v for v in known if top(-INF if low is None else low) <= top(v) < top(INF if high is None else high)]
        n, total = got[k]
        assert n == len(held), (low, high)
        if not held:
            assert total is None
        elif any(math.isinf(v) for v in held):
            assert str(total) == str(sum(held)), (low, high)
        else:  # a sum of powers of two, so digits are lost by size as in any sum of doubles
            assert abs(total - math.fsum(held)) <= 1e-15 * math.fsum(map(abs, held)), (low, high)


def test_band_sums_are_exact_above_large_values(spark):
    points = spark.createDataFrame([(v,) for v in (-1e30, 0.25, 0.5, 0.5, 1e30)], "l float")
    bands = spark.createDataFrame([(0, 0.2, 0.6), (0, 0.2, 0.6), (1, 0.6, 0.7), (2, 0.7, 0.6)], "band int, low double, high double")
    assert sorted(tuple(r)[0:1] + tuple(r)[3:] for r in band_sums(points, "l", bands, "low", "high").collect()) == [(0, 3, 1.25), (0, 3, 1.25), (1, 0, None), (2, 0, None)]
    assert [(r.n, r.total) for r in band_sums(points.where("1 = 0"), "l", bands, "low", "high").collect()] == [(0, None)] * 4
    assert band_sums(points, "l", bands.where("1 = 0"), "low", "high").count() == 0


def test_luminance_bands_makes_no_pairs(spark, tmp_path):
    """2,000 overlapping bands over 2,000 pixels are 4 million pairs; no step of the plan makes more rows than a few for each of both."""
    spark.range(2000).select(F.col("id").alias("event_id"), (F.col("id") % 50 + 40.0).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(0, 14000, 7).select((F.col("id") + 6).alias("s_suppkey"), F.lit(4350.0).alias("s_acctbal")).write.parquet(f"{tmp_path}/supplier.parquet")
    out = QUERIES["luminance_bands"](spark, str(tmp_path))
    got = out.collect()
    assert len(got) == 2000 and {(r.n, r["mean"]) for r in got} == {(240, 0.465)}
    counts, todo = [], [out._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            node = node.executedPlan()
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            node = node.plan()
        if node.metrics().contains("numOutputRows"):
            counts.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert counts and max(counts) <= 3 * 4000


# pyramid
def test_pyramid_reads_pixels_once(spark, sf_dir):
    out = tile_pyramid(events_image(spark, sf_dir), 4, 5)
    assert nodes(out, "Exchange") == 2 and plan_of(out).count("FileScan") == 1
    per = {r.level: r.n for r in out.groupBy("level").agg(F.sum("n").alias("n")).collect()}
    assert len(per) == 5 and len(set(per.values())) == 1
    small = tile_pyramid(pixels(spark, [1.0, None, 3.0]), 2, 2).orderBy("level", "tx").collect()
    assert [(r.level, r.tx, r.n, r.mean, r.variance, r.low, r.high) for r in small] == [(0, 0, 1, 1.0, 0.0, 1.0, 1.0), (0, 1, 1, 3.0, 0.0, 3.0, 3.0), (1, 0, 2, 2.0, 1.0, 1.0, 3.0)]


# brightest pixels
def test_brightest_against_sorting(spark):
    rng = random.Random(9)
    rows = [(i, y, x, rng.choice([None, NAN, INF, -INF, 0.5, 0.5, rng.random()])) for i in (0, 1, 2**40) for y in range(13) for x in range(9)]
    df = spark.createDataFrame(rows, "image_id long, y int, x int, l float").repartition(5)
    for k, tile in ((1, 4), (3, 4), (50, 3), (7, 100)):
        got = {}
        for r in brightest(df, k, tile).collect():
            got.setdefault((r.image_id, r.ty, r.tx), {})[r.place] = (r.y, r.x)
        want = {}
        for i, y, x, v in rows:
            if v is not None:
                want.setdefault((i, y // tile, x // tile), []).append(((0, 0) if math.isnan(v) else (1, -np.float32(v)), y, x))
        assert got == {t: {n + 1: (y, x) for n, (_, y, x) in enumerate(sorted(v)[:k])} for t, v in want.items()}
    assert brightest(df.where("1 = 0"), 2).count() == 0


def test_brightest_sends_k_rows_of_a_tile(spark):
    df = spark.range(40_000).select(F.lit(0).cast("long").alias("image_id"), (F.col("id") / 200).cast("int").alias("y"), (F.col("id") % 200).cast("int").alias("x"), F.rand(3).cast("float").alias("l")).coalesce(3)
    out = brightest(df, 4, 100)
    assert out.count() == 4 * 4
    sent = out._jdf.queryExecution().optimizedPlan()
    assert "MapInArrow" in sent.toString()
    per_task = brightest.__globals__["_first"]
    import pyarrow as pa

    rows = pa.table({"image_id": np.zeros(1000, np.int64), "y": np.arange(1000, dtype=np.int32) // 50, "x": np.arange(1000, dtype=np.int32) % 50, "l": np.random.default_rng(1).random(1000).astype(np.float32)})
    assert per_task(rows, 4, 100).num_rows == 4


# the bench times arithmetic, not a folded literal
def test_bench_images_are_no_literals(spark):
    import bench

    work = {"full_luminance": r"0\.7152 \* r?", "full_channel_mixer": r"0\.72 \* ", "full_color_filter": r"0\.07152 \* ", "full_zone_system": "EXP", "full_local_contrast": "MapInArrow", "full_encode_srgb": "POWER"}
    made = bench.full_size(spark, 40, 50)
    assert made.keys() == work.keys()
    for name, make in made.items():
        plan = make()._jdf.queryExecution().executedPlan().toString()
        assert re.search(work[name], plan) and "* 0.0)" in plan, (name, plan)
