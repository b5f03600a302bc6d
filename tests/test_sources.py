"""Sources, sinks, layouts and streams."""

import numpy as np

from lumisheet.operators import encode_srgb, local_contrast, luminance_bw, zone_system
from lumisheet.plans import Development
from lumisheet.presets import GuidedFilterParams, ZoneParams
from lumisheet.sources import color_chart, constant_image, from_numpy, orders_image, pixels_of, ramp_image, scanlines_of, to_numpy, write_ppm
from lumisheet.sources.ppm import ppm_bytes
from lumisheet.streaming import develop_batches, develop_pixels


def test_numpy_round_trip(spark):
    array = np.random.default_rng(1).random((5, 7, 3), np.float32)
    assert (to_numpy(from_numpy(spark, array), "r", "g", "b") == array).all()


def test_chart(spark):
    chart = to_numpy(color_chart(spark), "r", "g", "b")
    assert chart.shape == (256, 384, 3)
    assert np.allclose(chart[0, 0], (0.400, 0.225, 0.155)) and np.allclose(chart[255, 383], 0.031) and np.allclose(chart[64, 0], (0.763, 0.325, 0.031))


def test_ramp_and_constant(spark):
    assert np.allclose(to_numpy(ramp_image(spark, 8, 8), "l").ravel(), np.arange(64) / 64)
    assert (to_numpy(constant_image(spark, 3, 2, r=0.5, g=0.25), "r", "g") == np.float32([0.5, 0.25])).all()


def test_scanlines(spark):
    image = ramp_image(spark, 4, 6)
    lines = scanlines_of(image, "l")
    assert lines.count() == 4
    assert sorted(pixels_of(lines, "l").collect()) == sorted(image.collect())


def test_ppm(spark, tmp_path):
    image = from_numpy(spark, np.float32([[[0], [1]], [[0.5], [-3]]]))
    assert ppm_bytes(image) == b"P6\n2 2\n255\n" + bytes([0] * 3 + [255] * 3 + [128] * 3 + [0] * 3)
    write_ppm(encode_srgb(image, "l"), str(tmp_path / "x.ppm"))
    assert (tmp_path / "x.ppm").read_bytes().startswith(b"P6\n2 2\n255\n")


def test_streamed_pixels_and_images(spark, sf_dir, tmp_path):
    orders_image(spark, sf_dir).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(orders_image(spark, sf_dir).schema).parquet(str(tmp_path / "in"))
    toned = develop_pixels(stream, luminance_bw, lambda df: zone_system(df, ZoneParams({5: 1.0})))
    query = toned.writeStream.format("memory").queryName("toned").trigger(availableNow=True).start()
    query.awaitTermination()
    expected = zone_system(luminance_bw(orders_image(spark, sf_dir)), ZoneParams({5: 1.0}))
    assert spark.table("toned").exceptAll(expected).count() == 0 and spark.table("toned").count() == expected.count()
    develop = Development(zones=ZoneParams({5: 0.5}), contrast=GuidedFilterParams(3, 0.01))
    develop_batches(stream, develop, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert got.exceptAll(develop(orders_image(spark, sf_dir))).count() == 0 and got.count() == expected.count()


def test_methods_agree(spark, sf_dir):
    image = luminance_bw(orders_image(spark, sf_dir))
    params = GuidedFilterParams(5, 0.001)
    a = to_numpy(local_contrast(image, params, 0.8, method="sliding"), "l")
    for method in ("running", "tiles"):
        assert np.abs(a - to_numpy(local_contrast(image, params, 0.8, method=method, tile=16), "l")).max() < 1e-5


def test_contrast_plan_prunes_columns(spark, sf_dir):
    plan = luminance_bw(orders_image(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "o_clerk" not in plan and "Exchange" not in plan


def test_guided_filter_shuffles_three_times(spark, sf_dir):
    image = luminance_bw(orders_image(spark, sf_dir))
    plan = local_contrast(image, GuidedFilterParams(4, 0.01), 1.0, method="sliding")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3
    tiles = local_contrast(image, GuidedFilterParams(4, 0.01), 1.0, method="tiles")._jdf.queryExecution().executedPlan().toString()
    assert tiles.count("Exchange hashpartitioning") == 1
