"""Values and properties of the raster operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisheet.errors import ShapeError
from lumisheet.operators import box_sum, channel_mixer_bw, color_filter_bw, encode_srgb, exposure, guided_filter, local_contrast, luminance_bw, quantize_u8, zone_system
from lumisheet.presets import ColorFilter, GuidedFilterParams, LuminanceStandard, ZoneParams, filters, standards
from lumisheet.schema import as_linear_f32, completed, grid_faults
from lumisheet.sources import constant_image, from_numpy, ramp_image, to_numpy


def rgb(spark, *pixels):
    return from_numpy(spark, np.array([pixels], np.float32))


def grey(spark, *values):
    return from_numpy(spark, np.array(values, np.float32).reshape(1, -1, 1))


def values(df, c="l"):
    return to_numpy(df, c).ravel()


@pytest.mark.parametrize("standard", list(LuminanceStandard))
def test_primaries_give_the_weights(spark, standard):
    got = values(luminance_bw(rgb(spark, (1, 0, 0), (0, 1, 0), (0, 0, 1)), standard))
    assert got == pytest.approx(standard.weights(), abs=1e-6)
    assert sum(standard.weights()) == pytest.approx(1, abs=1e-5)


def test_default_standard(spark):
    image = rgb(spark, (1, 0, 0), (0, 1, 0))
    assert list(values(luminance_bw(image))) == list(values(luminance_bw(image, LuminanceStandard.Bt709)))
    assert LuminanceStandard.Bt709 == 1 and ColorFilter.Blue47C5 == 5


def test_mixer(spark):
    assert values(channel_mixer_bw(rgb(spark, (0.7, 0.3, 0.5)), 1, 0, 0))[0] == pytest.approx(0.7, abs=1e-7)
    assert values(channel_mixer_bw(rgb(spark, (0.5, 0.25, 1)), 2, -1, -0.5))[0] == pytest.approx(0.25, abs=1e-6)


@pytest.mark.parametrize("filter", list(ColorFilter))
@pytest.mark.parametrize("standard", list(LuminanceStandard))
def test_filter_values(spark, filter, standard):
    pixel = np.array([0.3, 0.8, 0.6], np.float32)
    w = np.array(standard.weights(), np.float32) * np.array(filter.transmission(), np.float32)
    assert values(color_filter_bw(rgb(spark, pixel), filter, standard))[0] == pytest.approx(float(w @ pixel), rel=1e-6)


def test_red_filter_darkens_blue(spark):
    assert values(color_filter_bw(rgb(spark, (0, 0, 1)), ColorFilter.Red25A))[0] == pytest.approx(0.001444, abs=1e-6)


def test_presets_as_tables(spark):
    assert standards(spark).count() == 3 and filters(spark).count() == 6
    assert filters(spark).where("name = 'Green11X1'").first()[1:] == pytest.approx((0.2, 1.0, 0.3))


def test_zones(spark):
    image = grey(spark, 0.18, 0.36, 0.0, -0.5, 7.0)
    assert (values(zone_system(image, ZoneParams({}))) == values(image)).all()
    got = values(zone_system(image, ZoneParams({5: 1.0})))
    assert got[0] == pytest.approx(0.36, abs=1e-6)
    assert got[1] == pytest.approx(0.36 * 2 ** math.exp(-1 / 1.28), rel=1e-5)
    assert got[2] == 0 and got[3] == pytest.approx(-0.5)  # far below all zones


def test_zones_add_up_in_order(spark):
    offsets = {7: 1.0, 3: -0.3, 5: 0.2}
    l = 0.3
    p = 5 + math.log2(l / 0.18)
    t = sum(s * math.exp(-((p - z) ** 2) / 1.28) for z, s in sorted(offsets.items()))
    assert values(zone_system(grey(spark, l), ZoneParams(offsets)))[0] == pytest.approx(l * 2**t, rel=1e-5)
    assert repr(ZoneParams(offsets)) == "ZoneParams({3: -0.3, 5: 0.2, 7: 1})"
    assert ZoneParams({5: 1}) == ZoneParams({5: 1.0}) and ZoneParams({5: 1}).offsets[5] == 1.0


def test_nan_and_infinity_pass(spark):
    got = values(zone_system(grey(spark, math.nan, math.inf), ZoneParams({5: 1.0})))
    assert math.isnan(got[0]) and got[1] == math.inf
    assert math.isnan(values(encode_srgb(grey(spark, math.nan), "l"))[0])


def test_encode(spark):
    got = values(encode_srgb(grey(spark, 0, 1, -0.5, 4, 0.0031308), "l"))
    assert got[0] == 0 and got[1] == pytest.approx(1, abs=1e-5)
    assert got[2] == pytest.approx(-6.46) and got[3] == pytest.approx(1.055 * 4 ** (1 / 2.4) - 0.055, rel=1e-6)
    assert got[4] == pytest.approx(1.055 * 0.0031308 ** (1 / 2.4) - 0.055, abs=1e-5)


def test_encode_is_monotonic(spark):
    got = values(encode_srgb(ramp_image(spark, 1, 10001, 10000), "l"))
    assert (np.diff(got) >= 0).all() and got.min() >= 0 and got.max() <= 1 + 1e-5


def test_exposure_and_quantize(spark):
    assert values(exposure(grey(spark, 0.25), 1.0, "l"))[0] == 0.5
    assert list(values(quantize_u8(grey(spark, -1, 0.5, 2, math.nan), "l"))) == [0, 128, 255, 0]


@pytest.mark.parametrize("method", ["sliding", "running", "tiles"])
def test_constant_images_keep_their_value(spark, method):
    image = constant_image(spark, 32, 24, l=0.3)
    got = values(local_contrast(image, GuidedFilterParams(4, 0.01), 0.5, method=method, tile=9))
    assert got == pytest.approx(0.3, abs=1e-4) and len(got) == 32 * 24


def test_radius_zero_is_identity(spark):
    image = ramp_image(spark, 8, 8)
    for method in ("sliding", "tiles"):
        assert values(local_contrast(image, GuidedFilterParams(0, 0.0), 1.0, method=method)) == pytest.approx(values(image), abs=1e-5)
    assert values(guided_filter(image, GuidedFilterParams(0, 0.0)), "q") == pytest.approx(values(image), abs=1e-5)


def brute_contrast(plane, r, eps, strength):
    h, w = plane.shape

    def box(p):
        return np.array([[p[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].astype(float).mean() for x in range(w)] for y in range(h)])

    mean = box(plane)
    var = box(plane * plane) - mean**2
    a = np.where(var + eps > 0, var / (var + eps), 0)
    q = box(a.astype(np.float32)) * plane + box((mean * (1 - a)).astype(np.float32))
    return plane + strength * (plane - q)


@pytest.mark.parametrize("method", ["sliding", "running", "tiles"])
@pytest.mark.parametrize(("radius", "eps"), [(1, 0.01), (3, 0.0005), (9, 0.1)])
def test_contrast_against_brute_force(spark, method, radius, eps):
    plane = np.random.default_rng(radius).random((13, 21), np.float32)
    plane[:, 10:] += 1  # an edge
    image = from_numpy(spark, plane[:, :, None])
    got = to_numpy(local_contrast(image, GuidedFilterParams(radius, eps), 0.7, method=method, tile=5), "l")[:, :, 0]
    assert got == pytest.approx(brute_contrast(plane, radius, eps, 0.7), abs=2e-5)


@pytest.mark.parametrize("method", ["sliding", "running", "tiles"])
def test_images_do_not_meet(spark, method):
    planes = np.random.default_rng(5).random((3, 6, 7), np.float32)
    images = from_numpy(spark, planes[0][:, :, None], 0)
    for k in (1, 2):
        images = images.union(from_numpy(spark, planes[k][:, :, None], k))
    out = local_contrast(images, GuidedFilterParams(2, 0.01), 1.0, method=method)
    for k in range(3):
        assert to_numpy(out.where(F.col("image_id") == k), "l")[:, :, 0] == pytest.approx(brute_contrast(planes[k], 2, 0.01, 1.0), abs=2e-5)


STRANGE = {(3, 4): "nan", (10, 2): "inf", (11, 15): "-inf", (11, 17): "inf", (5, 18): None, (6, 18): None}


def contrast_with_holes(plane, present, r, eps, strength):
    """Means over the present pixels of each window, with the rules of IEEE."""
    h, w = plane.shape

    def box(p):
        out = np.full(p.shape, np.nan)
        for y in range(h):
            for x in range(w):
                near = np.s_[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1]
                own = p[near][present[near]].astype(float)
                out[y, x] = own.sum() / len(own) if len(own) else np.nan
        return out

    with np.errstate(invalid="ignore"):
        mean = box(plane)
        var = box(plane * plane) - mean**2
        a = np.where(var + eps <= 0, 0, var / (var + eps))
        q = box(a.astype(np.float32)) * plane + box((mean * (1 - a)).astype(np.float32))
        return plane + strength * (plane - q)


@pytest.mark.parametrize("method", ["sliding", "running", "tiles"])
@pytest.mark.parametrize("sparse", [False, True])
def test_strange_and_missing_pixels(spark, method, sparse):
    plane = np.random.default_rng(1).random((16, 20), np.float32)
    image = from_numpy(spark, plane[:, :, None])
    present = np.ones(plane.shape, bool)
    for (y, x), v in STRANGE.items():
        image = image.withColumn("l", F.when((F.col("y") == y) & (F.col("x") == x), F.lit(v).cast("float")).otherwise(F.col("l")))
        plane[y, x] = np.nan if v is None else float(v)
        present[y, x] = v is not None
    if sparse:
        image = image.where("l IS NOT NULL")
        image = image if method == "tiles" else completed(image)
    got = local_contrast(image, GuidedFilterParams(2, 0.01), 0.7, method=method, tile=6)
    found = {(r.y, r.x): r.l for r in got.collect() if r.l is not None}
    expected = contrast_with_holes(plane, present, 2, 0.01, 0.7)
    assert found.keys() == {(y, x) for y, x in np.ndindex(plane.shape) if present[y, x]}
    for at, v in found.items():
        assert v == pytest.approx(expected[at], abs=2e-5, nan_ok=True), at
    far = [v for (y, x), v in found.items() if y > 8 and 7 < x < 11]
    assert far and all(map(math.isfinite, far))


def test_window_sums_keep_infinities_apart(spark):
    row = [1.0, 2.0, math.inf, 4.0, 5.0, 6.0, -math.inf, 8.0, math.nan, 10.0, 11.0, 12.0]
    image = spark.createDataFrame([(0, 0, x, v) for x, v in enumerate(row)], "image_id long, y int, x int, l float")
    expected = [sum(row[max(0, x - 1) : x + 2]) for x in range(len(row))]
    for method in ("sliding", "running"):
        got = [r.s for r in box_sum(image, {"l": "s"}, 1, method).orderBy("x").collect()]
        assert got == pytest.approx(expected, nan_ok=True)


def test_shape_errors(spark):
    with pytest.raises(ShapeError, match="shape error"):
        luminance_bw(grey(spark, 1.0))
    with pytest.raises(ValueError):
        zone_system(rgb(spark, (1, 1, 1)), ZoneParams({}))
    with pytest.raises(ShapeError):
        local_contrast(rgb(spark, (1, 1, 1)), GuidedFilterParams(1, 0.1), 1)
    double = grey(spark, 1.0).withColumn("l", F.col("l").cast("double"))
    with pytest.raises(ShapeError, match="double"):
        encode_srgb(double, "l")
    assert values(encode_srgb(as_linear_f32(double, "l"), "l"))[0] == pytest.approx(1, abs=1e-5)
    with pytest.raises(ShapeError):
        from_numpy(spark, np.zeros((2, 2, 3)))
    with pytest.raises(ShapeError):
        from_numpy(spark, np.zeros((2, 2, 2), np.float32))
    with pytest.raises(ValueError):
        GuidedFilterParams(-1, 0.1)


def test_empty_and_null(spark):
    empty = rgb(spark, (1, 1, 1)).where("x < 0")
    assert luminance_bw(empty).count() == 0
    assert local_contrast(luminance_bw(empty), GuidedFilterParams(2, 0.1), 1, method="tiles").count() == 0
    null = rgb(spark, (1, 1, 1)).withColumn("g", F.lit(None).cast("float"))
    assert luminance_bw(null).first().l is None


def test_grid_faults(spark):
    image = ramp_image(spark, 3, 4)
    assert grid_faults(image).count() == 0
    assert grid_faults(image.where("not (y = 1 and x = 2)")).count() == 1
    assert grid_faults(image.union(image.limit(1))).count() == 1


def test_too_many_zones(spark):
    table = spark.range(300).selectExpr("cast(id as int) as zone", "cast(1 as float) as stops")
    with pytest.raises(ValueError):
        ZoneParams.from_table(table)
    assert len(ZoneParams.from_table(table, 300).offsets) == 300


def test_plans_stay_in_code_generation(spark):
    image = rgb(spark, (1, 1, 1))
    plan = encode_srgb(zone_system(luminance_bw(image), ZoneParams({5: 1.0, 7: -1.0})), "l")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
