"""The registered queries of the raster operators, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import box_area
from .functions import filtered_weights as products
from .functions import lit32
from .operators import (
    ToneCurve, asof_join, band_sums, box_mean_var, box_sum, brightest, channel_mixer_bw, color_filter_bw, encode_srgb, equalize, exposure, film_grain, grey_to_rgb, guided_coefficients, guided_filter, hsl_bw,
    local_contrast, luminance_bw, percent_ranks, quantize_u8, sat, tile_pyramid, tone_curve, zone_system,
)
from .operators import grain
from .plans import Development
from .presets import ColorFilter, GuidedFilterParams, LuminanceStandard, ZoneParams
from .schema import grid_faults
from .sources import color_chart, constant_image, embeddings_images, events_image, orders_image, pixels_of, ppm_bytes, ramp_image, scanlines_of
from .sources.synthetic import CHART
from .streaming import assembled
from .streaming.assembly import shared_folder, state_session

Query = Callable[[SparkSession, str], DataFrame]
Source = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# the images in SQL
_IMAGES = """
f1 AS (SELECT 0::BIGINT AS image_id, CAST(o_orderkey // 150 AS INT) AS y, CAST(o_orderkey % 150 AS INT) AS x, CAST(CAST(o_totalprice AS DOUBLE) / 500000.0::DOUBLE AS FLOAT) AS r,
  CAST(CAST(o_custkey % 256 AS DOUBLE) / 255.0::DOUBLE AS FLOAT) AS g, CAST(CAST(CAST(substr(o_orderpriority, 1, 1) AS INT) AS DOUBLE) / 5.0::DOUBLE AS FLOAT) AS b FROM orders),
f2 AS (SELECT 0::BIGINT AS image_id, CAST(event_id // 100 AS INT) AS y, CAST(event_id % 100 AS INT) AS x, CAST(CAST(value AS DOUBLE) / 100.0::DOUBLE AS FLOAT) AS l FROM events),
f3 AS (SELECT vec_id AS image_id, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x, CAST(embedding[i] AS FLOAT) AS l FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings))"""


def _with(*steps: str) -> str:
    return "WITH " + ",\n".join((_IMAGES.strip(), *steps))


def _out(df: DataFrame, *values: str) -> DataFrame:
    """Keys and values, these rounded to five places (and without negative zeros)."""
    return df.select(*[c for c in ("image_id", "y", "x") if c in df.columns], *[(F.round(F.col(c).cast("double"), 5) + 0.0).alias(c) for c in values])


def _select(source: str, extra: str = "", **values: str) -> str:
    return f"SELECT image_id, y, x, {extra}" + ", ".join(f"round(CAST({v} AS DOUBLE), 5) + 0.0 AS {c}" for c, v in values.items()) + f" FROM {source}"


def _add(name: str, query: Query, sql: str) -> None:
    QUERIES[name] = query
    ORACLE_SQL[name] = sql


def _dot(weights) -> str:
    return " + ".join(f"{w!r}::FLOAT * {c}" for w, c in zip(weights, "rgb", strict=True))


# conversions to luminance
for _s in LuminanceStandard:
    _add(f"luminance_{_s.name.lower()}", lambda spark, d, s=_s: _out(luminance_bw(orders_image(spark, d), s), "l"), _with() + _select("f1", l=_dot(_s.weights())))
for _name, _w in (("channel_mixer", (0.4, 0.35, 0.25)), ("channel_mixer_negative", (1.4, -0.3, -0.2))):
    _add(_name, lambda spark, d, w=_w: _out(channel_mixer_bw(orders_image(spark, d), *w), "l"), _with() + _select("f1", l=_dot(_w)))


def _filtered(f: ColorFilter, s: LuminanceStandard) -> str:
    return " + ".join(f"({t!r}::FLOAT * {w!r}::FLOAT) * {c}" for t, w, c in zip(f.transmission(), s.weights(), "rgb", strict=True))


for _name, _f in zip(("none", "yellow", "orange", "red", "green", "blue"), ColorFilter, strict=True):
    _add(f"filter_{_name}", lambda spark, d, f=_f: _out(color_filter_bw(orders_image(spark, d), f), "l"), _with() + _select("f1", l=_filtered(_f, LuminanceStandard.Bt709)))
_add(
    "filter_red_bt2020",
    lambda spark, d: _out(color_filter_bw(orders_image(spark, d), ColorFilter.Red25A, LuminanceStandard.Bt2020), "l"),
    _with() + _select("f1", l=_filtered(ColorFilter.Red25A, LuminanceStandard.Bt2020)),
)


def filter_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All filters under all standards, from one scan of the image."""
    dot = lambda w: lit32(w[0]) * F.col("r") + lit32(w[1]) * F.col("g") + lit32(w[2]) * F.col("b")
    pairs = [(f, s) for f in ColorFilter for s in LuminanceStandard]
    cell = lambda f, s: F.struct(F.lit(f.name).alias("filter"), F.lit(s.name).alias("standard"), dot(products(f.transmission(), s.weights())).alias("l"))
    cells = orders_image(spark, sf_dir).select("image_id", "y", "x", F.inline(F.array(*[cell(f, s) for f, s in pairs])))
    return cells.select("image_id", "y", "x", "filter", "standard", (F.round(F.col("l").cast("double"), 5) + 0.0).alias("l"))


_add(
    "filter_matrix",
    filter_matrix,
    _with(
        "w(filter, standard, wr, wg, wb) AS (VALUES "
        + ", ".join(f"('{f.name}', '{s.name}', " + ", ".join(f"{t!r}::FLOAT * {w!r}::FLOAT" for t, w in zip(f.transmission(), s.weights(), strict=True)) + ")" for f in ColorFilter for s in LuminanceStandard)
        + ")"
    )
    + _select("f1, w", "filter, standard, ", l="wr * r + wg * g + wb * b"),
)


# tone
def _zoned(l: str, offsets: dict[int, float]) -> str:
    p = f"(5.0::DOUBLE + ln(greatest(CAST({l} AS DOUBLE), 1e-10::DOUBLE)) / ln(2.0::DOUBLE) - ln(0.18::DOUBLE) / ln(2.0::DOUBLE))"
    terms = " + ".join(f"CAST({s!r}::FLOAT AS DOUBLE) * exp(-(({p} - {float(z)!r}::DOUBLE) * ({p} - {float(z)!r}::DOUBLE)) / 1.28::DOUBLE)" for z, s in sorted(offsets.items()))
    return f"CAST(CAST({l} AS DOUBLE) * pow(2.0::DOUBLE, {terms or '0.0'}) AS FLOAT)"


_MULTI = {3: -0.3, 5: 0.0, 7: 1.0}
_LUMA = "lu AS (SELECT image_id, y, x, " + _dot(LuminanceStandard.Bt709.weights()) + " AS l FROM f1)"
_add("zone_identity", lambda spark, d: _out(zone_system(events_image(spark, d), ZoneParams({})), "l"), _with() + _select("f2", l="l"))
_add("zone_single", lambda spark, d: _out(zone_system(luminance_bw(orders_image(spark, d)), ZoneParams({5: 1.0})), "l"), _with(_LUMA) + _select("lu", l=_zoned("l", {5: 1.0})))
_add("zone_multi", lambda spark, d: _out(zone_system(events_image(spark, d), ZoneParams(_MULTI)), "l"), _with() + _select("f2", l=_zoned("l", _MULTI)))


def zone_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones from a table: here the nations of each region, as stops."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy((F.col("n_regionkey") + 3).cast("int").alias("zone")).agg((F.count("*") / 10.0).cast("float").alias("stops"))
    return _out(zone_system(events_image(spark, sf_dir), ZoneParams.from_table(nations)), "l")


_add(
    "zone_table",
    zone_table,
    _with(
        "z AS (SELECT n_regionkey + 3 AS zone, CAST(count(*) / 10.0::DOUBLE AS FLOAT) AS stops FROM nation GROUP BY 1)",
        "p AS (SELECT *, 5.0::DOUBLE + ln(greatest(CAST(l AS DOUBLE), 1e-10::DOUBLE)) / ln(2.0::DOUBLE) - ln(0.18::DOUBLE) / ln(2.0::DOUBLE) AS p FROM f2)",
        "t AS (SELECT image_id, y, x, any_value(l) AS l, sum(CAST(stops AS DOUBLE) * exp(-((p - zone) * (p - zone)) / 1.28::DOUBLE)) AS t FROM p, z GROUP BY image_id, y, x)",
    )
    + _select("t", l="CAST(CAST(l AS DOUBLE) * pow(2.0::DOUBLE, t) AS FLOAT)"),
)
_add("zone_nonpositive", lambda spark, d: _out(zone_system(embeddings_images(spark, d), ZoneParams({2: 0.5, 6: -1.0})), "l"), _with() + _select("f3", l=_zoned("l", {2: 0.5, 6: -1.0})))
_add(
    "exposure_plus1",
    lambda spark, d: _out(exposure(orders_image(spark, d), 1.0, "r", "g", "b"), "r", "g", "b"),
    _with() + _select("f1", r="r * 2.0::FLOAT", g="g * 2.0::FLOAT", b="b * 2.0::FLOAT"),
)


# encoding
def _srgb(c: str) -> str:
    return f"CASE WHEN {c} <= 0.0031308::FLOAT THEN 12.92::FLOAT * {c} ELSE CAST(1.055::DOUBLE * pow(CAST({c} AS DOUBLE), 1.0::DOUBLE / 2.4::DOUBLE) - 0.055::DOUBLE AS FLOAT) END"


_add("encode_luminance", lambda spark, d: _out(encode_srgb(events_image(spark, d), "l"), "l"), _with() + _select("f2", l=_srgb("l")))
_add("encode_rgb", lambda spark, d: _out(encode_srgb(orders_image(spark, d), "r", "g", "b"), "r", "g", "b"), _with() + _select("f1", r=_srgb("r"), g=_srgb("g"), b=_srgb("b")))
_add("encode_hdr_negative", lambda spark, d: _out(encode_srgb(embeddings_images(spark, d), "l"), "l"), _with() + _select("f3", l=_srgb("greatest(l, 0::FLOAT)").replace("12.92::FLOAT * greatest(l, 0::FLOAT)", "12.92::FLOAT * l")))
_U8 = "CAST(floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CAST({0} AS DOUBLE))) * 255 + 0.5) AS INT) AS {0}"
_add(
    "quantize_u8",
    lambda spark, d: quantize_u8(orders_image(spark, d), "r", "g", "b"),
    _with() + "SELECT image_id, y, x, " + ", ".join(_U8.format(c) for c in "rgb") + " FROM f1",
)
_add(
    "grey_to_rgb",
    lambda spark, d: quantize_u8(grey_to_rgb(events_image(spark, d)), "r", "g", "b"),
    _with("e AS (SELECT image_id, y, x, l AS r, l AS g, l AS b FROM f2)") + "SELECT image_id, y, x, " + ", ".join(_U8.format(c) for c in "rgb") + " FROM e",
)


# windows
def _boxes(source: str, radius: int, **sums: str) -> list[str]:
    """Steps bx and by: window sums over rows, then columns, and the cell count n."""
    frame = f"RANGE BETWEEN {radius} PRECEDING AND {radius} FOLLOWING"
    rows = ", ".join(f"sum(CAST({v} AS DOUBLE)) OVER w AS {c}" for c, v in sums.items())
    cols = ", ".join(f"sum({c}) OVER w AS {c}" for c in sums)
    return [
        f"bx_{source} AS (SELECT * EXCLUDE ({', '.join(['nothing', *sums])}), {rows}, sum(1.0::DOUBLE) OVER w AS n FROM (SELECT *, 0 AS nothing, {', '.join(f'0 AS {c}' for c in sums)} FROM {source}) WINDOW w AS (PARTITION BY image_id, y ORDER BY x {frame}))",
        f"by_{source} AS (SELECT * EXCLUDE (n, {', '.join(sums)}), {cols}, sum(n) OVER w AS n FROM bx_{source} WINDOW w AS (PARTITION BY image_id, x ORDER BY y {frame}))",
    ]


def _guided(source: str, radius: int, eps: float) -> list[str]:
    e = f"CAST({eps!r}::FLOAT AS DOUBLE)"
    return [
        *_boxes(source, radius, s="l", s2="l * l"),
        f"mv_{source} AS (SELECT image_id, y, x, l, s / n AS mean, s2 / n - (s / n) * (s / n) AS variance FROM by_{source})",
        f"ad_{source} AS (SELECT *, CASE WHEN variance + {e} > 0 THEN variance / (variance + {e}) ELSE 0.0::DOUBLE END AS a0 FROM mv_{source})",
        f"ab_{source} AS (SELECT image_id, y, x, l, CAST(a0 AS FLOAT) AS a, CAST(mean * (1.0::DOUBLE - a0) AS FLOAT) AS b FROM ad_{source})",
        *_boxes(f"ab_{source}", radius, sa="a", sb="b"),
        f"g_{source} AS (SELECT image_id, y, x, l, CAST(sa / n * CAST(l AS DOUBLE) + sb / n AS FLOAT) AS q FROM by_ab_{source})",
    ]


_P4, _P8, _P2 = GuidedFilterParams(4, 0.01), GuidedFilterParams(8, 0.01), GuidedFilterParams(2, 0.001)
_add(
    "sat",
    lambda spark, d: _out(sat(events_image(spark, d)), "sat"),
    _with("r0 AS (SELECT *, sum(CAST(l AS DOUBLE)) OVER (PARTITION BY image_id, y ORDER BY x) AS s FROM f2)", "c0 AS (SELECT *, sum(s) OVER (PARTITION BY image_id, x ORDER BY y) AS t FROM r0)") + _select("c0", sat="t"),
)
_add("box_sum", lambda spark, d: _out(box_sum(events_image(spark, d), {"l": "total"}, 4), "total"), _with(*_boxes("f2", 4, s="l")) + _select("by_f2", total="s"))
_add("box_sum_running", lambda spark, d: _out(box_sum(events_image(spark, d), {"l": "total"}, 40, "running"), "total"), _with(*_boxes("f2", 40, s="l")) + _select("by_f2", total="s"))


def box_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of each window in closed form, height and width from the image itself."""
    image = events_image(spark, sf_dir)
    size = image.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    return image.join(size, "image_id").select("image_id", "y", "x", box_area(F.col("y"), F.col("x"), F.col("h"), F.col("w"), 4).alias("area"))


_add("box_area", box_areas, _with(*_boxes("f2", 4, s="l")) + "SELECT image_id, y, x, CAST(n AS BIGINT) AS area FROM by_f2")
_add("box_mean_var", lambda spark, d: _out(box_mean_var(events_image(spark, d), 4), "mean", "variance"), _with(*_guided("f2", 4, 0.01)) + _select("mv_f2", mean="mean", variance="variance"))
_add("guided_coefficients", lambda spark, d: _out(guided_coefficients(events_image(spark, d), _P4), "a", "b"), _with(*_guided("f2", 4, 0.01)) + _select("ab_f2", a="a", b="b"))
_add("guided_filter", lambda spark, d: _out(guided_filter(events_image(spark, d), _P8), "q"), _with(*_guided("f2", 8, 0.01)) + _select("g_f2", q="q"))
_add("guided_radius0", lambda spark, d: _out(guided_filter(events_image(spark, d), GuidedFilterParams(0, 0.0)), "q"), _with(*_guided("f2", 0, 0.0)) + _select("g_f2", q="q"))
_CONTRAST = "l + 0.5::FLOAT * (l - q)"
for _name, _method in (("local_contrast", "sliding"), ("local_contrast_running", "running"), ("local_contrast_tiles", "tiles")):
    _add(_name, lambda spark, d, m=_method: _out(local_contrast(events_image(spark, d), _P8, 0.5, method=m), "l"), _with(*_guided("f2", 8, 0.01)) + _select("g_f2", l=_CONTRAST))
_add("local_contrast_strength0", lambda spark, d: _out(local_contrast(events_image(spark, d), _P4, 0.0), "l"), _with() + _select("f2", l="l"))
_add("local_contrast_multi_image", lambda spark, d: _out(local_contrast(embeddings_images(spark, d), _P2, 1.0), "l"), _with(*_guided("f3", 2, 0.001)) + _select("g_f3", l="l + 1.0::FLOAT * (l - q)"))

# sources and layouts
_CHART = "chart AS (SELECT 0::BIGINT AS image_id, CAST(i // 384 AS INT) AS y, CAST(i % 384 AS INT) AS x, r, g, b FROM (SELECT range AS i FROM range(98304)), (VALUES " + ", ".join(f"({i}, {r!r}::FLOAT, {g!r}::FLOAT, {b!r}::FLOAT)" for i, (r, g, b) in enumerate(CHART)) + ") p(patch, r, g, b) WHERE patch = (i // 384 // 64) * 6 + (i % 384) // 64)"
_add("color_chart_luminance", lambda spark, d: _out(luminance_bw(color_chart(spark)), "l"), _with(_CHART) + _select("chart", l=_dot(LuminanceStandard.Bt709.weights())))
_CHART_LUMA = "lu AS (SELECT image_id, y, x, " + _dot(LuminanceStandard.Bt709.weights()) + " AS l FROM chart)"
for _r in (8, 16):
    _add(f"color_chart_contrast{_r}", lambda spark, d, r=_r: _out(local_contrast(luminance_bw(color_chart(spark)), GuidedFilterParams(r, 0.01), 0.5), "l"), _with(_CHART, _CHART_LUMA, *_guided("lu", _r, 0.01)) + _select("g_lu", l=_CONTRAST))
for _n, _map in (("lift", {5: 0.5}), ("darken", {5: -1.0}), ("split", {7: 1.0, 3: -0.5})):
    _add(f"color_chart_zones_{_n}", lambda spark, d, m=_map: _out(zone_system(luminance_bw(color_chart(spark)), ZoneParams(m)), "l"), _with(_CHART, _CHART_LUMA) + _select("lu", l=_zoned("l", _map)))
_GRID = "SELECT 0::BIGINT AS image_id, CAST(range // {w} AS INT) AS y, CAST(range % {w} AS INT) AS x, {v} AS l FROM range({n})"
_add("constant_image", lambda spark, d: _out(constant_image(spark, 48, 64, l=0.18), "l"), _with("c AS (" + _GRID.format(w=64, n=48 * 64, v="0.18::FLOAT") + ")") + _select("c", l="l"))
_add("ramp_image", lambda spark, d: _out(encode_srgb(ramp_image(spark, 1, 10001, 10000), "l"), "l"), _with("c AS (" + _GRID.format(w=10001, n=10001, v="CAST(CAST(range AS DOUBLE) / 10000.0::DOUBLE AS FLOAT)") + ")") + _select("c", l=_srgb("l")))


def ppm_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and checksum of the chart as a PPM file."""
    raw = spark.createDataFrame([(ppm_bytes(encode_srgb(color_chart(spark), "r", "g", "b")),)], "file binary")
    return raw.select(F.octet_length("file").cast("long").alias("n_bytes"), F.sha2("file", 256).alias("sha256"))


_add(
    "ppm_file",
    ppm_file,
    _with(_CHART, "e AS (SELECT y, x, " + ", ".join(f"{_srgb(c)} AS {c}" for c in "rgb") + " FROM chart)", "q AS (SELECT y, x, " + ", ".join(_U8.format(c) for c in "rgb") + " FROM e)")
    + "SELECT CAST(15 + 3 * count(*) AS BIGINT) AS n_bytes, sha256(unhex(hex(encode('P6' || chr(10) || '384 256' || chr(10) || '255' || chr(10))) || string_agg(printf('%02X%02X%02X', r, g, b), '' ORDER BY y, x))) AS sha256 FROM q",
)
_add("scanlines", lambda spark, d: _out(pixels_of(scanlines_of(orders_image(spark, d), "r", "g", "b"), "r", "g", "b"), "r", "g", "b"), _with() + _select("f1", r="r", g="g", b="b"))
_add(
    "grid_faults",
    lambda spark, d: grid_faults(spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") % 7).cast("long").alias("image_id"), F.col("l_orderkey").cast("int").alias("y"), F.col("l_linenumber").cast("int").alias("x"))),
    """SELECT * FROM (SELECT CAST(l_orderkey % 7 AS BIGINT) AS image_id, count(*) AS pixels, count(DISTINCT (l_orderkey, l_linenumber)) AS cells, CAST(min(l_orderkey) AS INT) AS y0, CAST(max(l_orderkey) AS INT) AS y1,
CAST(min(l_linenumber) AS INT) AS x0, CAST(max(l_linenumber) AS INT) AS x1 FROM lineitem GROUP BY 1) WHERE pixels <> (y1 + 1) * (x1 + 1) OR cells <> (y1 + 1) * (x1 + 1) OR y0 <> 0 OR x0 <> 0""",
)


def pipeline_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: exposure, luminance, zones, local contrast and encoding of one image."""
    develop = Development(stops=0.5, zones=ZoneParams({4: -0.3, 7: 0.5}), contrast=_P8, strength=0.5)
    return _out(develop(orders_image(spark, sf_dir)), "l")


_add(
    "pipeline_full",
    pipeline_full,
    _with(
        "ex AS (SELECT image_id, y, x, " + ", ".join(f"{c} * {2.0**0.5!r}::FLOAT AS {c}" for c in "rgb") + " FROM f1)",
        "lu AS (SELECT image_id, y, x, " + _dot(LuminanceStandard.Bt709.weights()) + " AS l FROM ex)",
        "zo AS (SELECT image_id, y, x, " + _zoned("l", {4: -0.3, 7: 0.5}) + " AS l FROM lu)",
        *_guided("zo", 8, 0.01),
        f"lc AS (SELECT image_id, y, x, {_CONTRAST} AS l FROM g_zo)",
    )
    + _select("lc", l=_srgb("l")),
)


# extensions: grain
def _mixed(h: str) -> str:
    a = f"xor({h}, ({h}) >> 16)"
    b = f"(({a} * {grain.MIX[0]}) & {grain.MASK})"
    c = f"xor({b}, {b} >> 15)"
    d = f"(({c} * {grain.MIX[1]}) & {grain.MASK})"
    return f"xor({d}, {d} >> 16)"


def _grained(source: str, strength: float, seed: int, size: int) -> list[str]:
    corners = range(2 if size > 1 else 1)
    times = lambda v, k: f"((CAST({v} AS BIGINT) & {grain.MASK}) * {grain.SPREAD[k]}) & {grain.MASK}"
    base = (seed & grain.MASK) * grain.SPREAD[0] + (seed >> 32 & grain.MASK) * grain.SPREAD[4] & grain.MASK
    line = lambda i: f"(({base} + ({times('image_id', 1)}) + ({times('image_id >> 32', 2)}) + ({times(f'(y // {size} + {i})', 3)})) & {grain.MASK})"
    gauss = lambda i, j: f"sqrt(-2.0::DOUBLE * ln((h{i}{j} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)) * cos(CAST(k{i}{j} AS DOUBLE) * (2 * pi() / 4294967296.0::DOUBLE))"
    wy, wx = ([f"(1.0::DOUBLE - CAST({c} % {size} AS DOUBLE) / {size}.0::DOUBLE)", f"(CAST({c} % {size} AS DOUBLE) / {size}.0::DOUBLE)"] for c in "yx")
    both = " + ".join(f"{wy[i]} * {wx[j]} * {gauss(i, j)}" for i in corners for j in corners)
    norm = " * ".join(f"({w[0]} * {w[0]} + {w[1]} * {w[1]})" for w in (wy, wx))
    t = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, CAST(l AS DOUBLE)))"
    pairs = [(i, j) for i in corners for j in corners]
    return [
        f"gl AS (SELECT *, {', '.join(f'{line(i)} AS b{i}' for i in corners)} FROM {source})",
        f"gm AS (SELECT *, {', '.join(f'{_mixed(f"b{i}")} AS n{i}' for i in corners)} FROM gl)",
        f"gc AS (SELECT *, {', '.join(f'((n{i} + ({times(f"(x // {size} + {j})", 4)})) & {grain.MASK}) AS c{i}{j}' for i, j in pairs)} FROM gm)",
        f"gh AS (SELECT *, {', '.join(f'{_mixed(f"c{i}{j}")} AS h{i}{j}' for i, j in pairs)} FROM gc)",
        f"gk AS (SELECT *, {', '.join(f'{_mixed(f"xor(h{i}{j}, {grain.SECOND})")} AS k{i}{j}' for i, j in pairs)} FROM gh)",
        f"gr AS (SELECT image_id, y, x, CAST(CAST(l AS DOUBLE) + {strength!r}::DOUBLE * sqrt(4.0::DOUBLE * {t} * (1.0::DOUBLE - {t})) * ({both if size == 1 else f'({both}) / sqrt({norm})'}) AS FLOAT) AS l FROM gk)",
    ]


_SEED = 2**40 + 20240117
_add("film_grain", lambda spark, d: _out(film_grain(events_image(spark, d), 0.1, _SEED, 3), "l"), _with(*_grained("f2", 0.1, _SEED, 3)) + _select("gr", l="l"))
_add("film_grain_fine", lambda spark, d: _out(film_grain(embeddings_images(spark, d), 0.2, -5), "l"), _with(*_grained("f3", 0.2, -5, 1)) + _select("gr", l="l"))

# extensions: ranks
_RANKED = "pr AS (SELECT *, percent_rank() OVER (PARTITION BY image_id ORDER BY l) AS rank FROM {0})"
_add("percent_ranks", lambda spark, d: _out(percent_ranks(events_image(spark, d)), "l", "rank"), _with(_RANKED.format("f2")) + _select("pr", l="l", rank="rank"))
_add(
    "equalize_images",
    lambda spark, d: _out(equalize(embeddings_images(spark, d), 0.75, 0.9), "l"),
    _with(_RANKED.format("f3")) + _select("pr", l="CAST(CAST(l AS DOUBLE) + 0.75::DOUBLE * (0.9::DOUBLE * rank - CAST(l AS DOUBLE)) AS FLOAT)"),
)


# extensions: a tone curve from a table
def curve_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knots are the years of orders and the squared share of orders up to each; the curve develops the events image."""
    years = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    share = F.sum("n").over(Window.orderBy("year")) / F.sum("n").over(Window.partitionBy())  # a row for each year
    knots = years.select(((F.col("year") - 1994) / F.lit(7.0)).alias("x"), F.pow(share, F.lit(2.0)).alias("y"))
    curve = ToneCurve(((0.0, 0.0), *ToneCurve.from_table(knots).knots))
    return _out(tone_curve(events_image(spark, sf_dir), curve), "l")


_add(
    "tone_curve",
    curve_from_orders,
    _with(
        "yr AS (SELECT year(o_orderdate) AS yr, CAST(count(*) AS DOUBLE) AS c FROM orders GROUP BY 1)",
        "kn AS (SELECT CAST(yr - 1994 AS DOUBLE) / 7.0::DOUBLE AS x, pow(sum(c) OVER (ORDER BY yr) / sum(c) OVER (), 2.0::DOUBLE) AS y FROM yr UNION ALL SELECT 0.0::DOUBLE, 0.0::DOUBLE)",
        "ch AS (SELECT x, y, x - lag(x) OVER w AS h0, lead(x) OVER w - x AS h1, (y - lag(y) OVER w) / (x - lag(x) OVER w) AS d0, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS d1 FROM kn WINDOW w AS (ORDER BY x))",
        "sl AS (SELECT x, y, h1, d1, CASE WHEN d0 IS NULL THEN d1 WHEN d1 IS NULL THEN d0 WHEN d0 * d1 <= 0 THEN 0 ELSE (3 * h0 + 3 * h1) / ((h0 + 2 * h1) / d0 + (2 * h0 + h1) / d1) END AS m FROM ch)",
        "pc AS (SELECT *, lead(x) OVER (ORDER BY x) AS x1, lead(m) OVER (ORDER BY x) AS m1, max(x) OVER () AS x9, min(x) OVER () AS x0 FROM sl)",
        "cv AS (SELECT image_id, f2.y, f2.x, greatest(x0, least(x9, CAST(l AS DOUBLE))) - pc.x AS u, pc.y AS c0, m AS c1, (3 * d1 - 2 * m - m1) / h1 AS c2, (m + m1 - 2 * d1) / (h1 * h1) AS c3 FROM f2 JOIN pc ON greatest(x0, least(x9, CAST(l AS DOUBLE))) >= pc.x AND (greatest(x0, least(x9, CAST(l AS DOUBLE))) < x1 OR x1 = x9) WHERE h1 IS NOT NULL)",
    )
    + _select("cv", l="CAST(((c3 * u + c2) * u + c1) * u + c0 AS FLOAT)"),
)


# extensions: joins
def exposure_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the exposure that the last purchase of its user has set, applied to its value."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    settings = events.where("event_type = 'purchase'").select("user_id", "ts", (F.col("value") / 10.0).alias("stops"))
    found = asof_join(events.where("event_type <> 'purchase'").select("event_id", "user_id", "ts", "value"), settings, "user_id", "ts", "stops")
    gap = F.timestamp_diff("MICROSECOND", F.col("stops_ts"), F.col("ts"))
    return found.select("event_id", "user_id", gap.alias("age"), F.round(F.col("stops"), 5).alias("stops"), F.round(F.col("value") * F.pow(F.lit(2.0), F.coalesce("stops", F.lit(0.0)) / 10.0), 4).alias("exposed"))


_add(
    "asof_exposure",
    exposure_asof,
    """WITH st AS (SELECT user_id, ts, max(value / 10.0::DOUBLE) AS stops FROM events WHERE event_type = 'purchase' GROUP BY 1, 2), ev AS (SELECT * FROM events WHERE event_type <> 'purchase')
SELECT event_id, ev.user_id, epoch_us(ev.ts) - epoch_us(st.ts) AS age, round(stops, 5) AS stops, round(value * pow(2.0::DOUBLE, coalesce(stops, 0.0::DOUBLE) / 10.0::DOUBLE), 4) AS exposed FROM ev ASOF LEFT JOIN st ON ev.user_id = st.user_id AND ev.ts >= st.ts""",
)


def luminance_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of the events image in the luminance band of each supplier; bands overlap, and one in seven is empty."""
    low, width = F.col("s_acctbal") / 10000.0, (F.col("s_suppkey") % 7) * F.lit(0.01)
    bands = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", low.alias("low"), (low + width).alias("high"))
    held = band_sums(events_image(spark, sf_dir), "l", bands, "low", "high").groupBy("s_suppkey").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return held.select("s_suppkey", "n", (F.round(F.try_divide("total", "n"), 5) + 0.0).alias("mean"))


_add(
    "luminance_bands",
    luminance_bands,
    _with("bd AS (SELECT s_suppkey, s_acctbal / 10000.0::DOUBLE AS low, s_acctbal / 10000.0::DOUBLE + CAST(s_suppkey % 7 AS DOUBLE) * 0.01::DOUBLE AS high FROM supplier)")
    + "SELECT s_suppkey, count(l) AS n, round(avg(CAST(l AS DOUBLE)), 5) + 0.0 AS mean FROM bd LEFT JOIN f2 ON CAST(l AS DOUBLE) >= low AND CAST(l AS DOUBLE) < high GROUP BY s_suppkey",
)

# extensions: a pyramid of tiles
_add(
    "tile_pyramid",
    lambda spark, d: tile_pyramid(events_image(spark, d), 8, 4).select("image_id", "level", "ty", "tx", "n", *[(F.round(F.col(c).cast("double"), 5) + 0.0).alias(c) for c in ("mean", "variance", "low", "high")]),
    _with(
        "lv AS (SELECT image_id, CAST(level AS INT) AS level, CAST(y // (8 << level) AS INT) AS ty, CAST(x // (8 << level) AS INT) AS tx, CAST(l AS DOUBLE) AS v FROM f2, range(4) r(level))",
        "ag AS (SELECT image_id, level, ty, tx, count(*) AS n, avg(v) AS mean, var_pop(v) AS variance, min(v) AS low, max(v) AS high FROM lv GROUP BY ALL)",
    )
    + "SELECT image_id, level, ty, tx, n, "
    + ", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in ("mean", "variance", "low", "high"))
    + " FROM ag",
)

# extensions: hue bands
_HUES = (0.5, -0.25, 1.0, 0.0, -1.0, 0.75, 0.2, -0.6)
_HELD = {c: f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, CAST({c} AS DOUBLE)))" for c in "rgb"}
_add(
    "hsl_bw",
    lambda spark, d: _out(hsl_bw(orders_image(spark, d), _HUES), "l"),
    _with(
        "hs AS (SELECT image_id, y, x, " + _dot(LuminanceStandard.Bt709.weights()) + " AS l, " + ", ".join(f"{v} AS {c}" for c, v in _HELD.items()) + " FROM f1)",
        "he AS (SELECT *, greatest(r, g, b) AS top, least(r, g, b) AS low FROM hs)",
        "hw AS (SELECT *, CASE WHEN top = low THEN NULL WHEN top = r THEN (g - b) / (top - low) WHEN top = g THEN (b - r) / (top - low) + 2 ELSE (r - g) / (top - low) + 4 END AS side, (top - low) / nullif(1 - abs(top + low - 1), 0) AS s FROM he)",
        "hp AS (SELECT *, (CASE WHEN side < 0 THEN side + 6 ELSE side END) * (8.0::DOUBLE / 6.0::DOUBLE) AS hue FROM hw)",
        f"hg AS (SELECT *, [{', '.join(f'{v!r}::DOUBLE' for v in _HUES)}] AS t, hue - floor(hue) AS f, CAST(floor(hue) AS INT) AS i FROM hp)",
    )
    + _select("hg", l="CASE WHEN side IS NULL THEN l ELSE CAST(CAST(l AS DOUBLE) * pow(2.0::DOUBLE, s * (t[i % 8 + 1] * (1 - f) + t[(i + 1) % 8 + 1] * f)) AS FLOAT) END"),
)

# extensions: the brightest pixels
_add(
    "brightest_pixels",
    lambda spark, d: brightest(events_image(spark, d), 5, 8).withColumn("l", F.round(F.col("l").cast("double"), 5) + 0.0),
    _with("rk AS (SELECT image_id, CAST(y // 8 AS INT) AS ty, CAST(x // 8 AS INT) AS tx, row_number() OVER (PARTITION BY image_id, y // 8, x // 8 ORDER BY l DESC, y, x) AS place, y, x, l FROM f2)")
    + "SELECT image_id, ty, tx, CAST(place AS INT) AS place, y, x, round(CAST(l AS DOUBLE), 5) + 0.0 AS l FROM rk WHERE place <= 5",
)


# extensions: images that arrive in parts
def assembled_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of pixels: sixteen fill an image of 2 x 3 cells at the place of their user, so cells are doubled, absent or sent anew."""
    session = state_session(spark)
    path = f"{sf_dir}/events.parquet"
    key, cell = F.col("event_id"), F.col("user_id") % 6
    stream = session.readStream.schema(session.read.parquet(path).schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern, as a stream takes no path of one file
    pixels = stream.select(
        F.floor(key / 16).alias("image_id"), F.floor(cell / 3).cast("int").alias("y"), (cell % 3).cast("int").alias("x"), (F.col("value") / 100.0).cast("float").alias("l"),
        F.lit(2).alias("height"), F.lit(3).alias("width"), F.col("ts").cast("timestamp").alias("ts"),
    )
    assembled(pixels, folder := shared_folder(spark, "assembled"), "l", wait="2 hours", delay="1 day")
    since = lambda c: F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp"), F.col(c)).alias(c)
    return spark.read.parquet(f"{folder}/out").select("image_id", "y", "x", since("opened"), since("closed"), "whole", (F.round(F.col("l").cast("double"), 5) + 0.0).alias("l"))


_add(
    "assembled_images",
    assembled_images,
    """WITH RECURSIVE ev AS (SELECT event_id // 16 AS image_id, CAST(user_id % 6 // 3 AS INT) AS y, CAST(user_id % 3 AS INT) AS x, CAST(value / 100.0::DOUBLE AS FLOAT) AS l, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS t FROM events),
op AS (SELECT DISTINCT image_id, t AS opened FROM ev),
ce AS (SELECT image_id, opened, y, x, min(t) AS t, arg_min(l, (t, l)) AS l FROM op JOIN ev USING (image_id) WHERE t BETWEEN opened AND opened + 7200000000 GROUP BY ALL),
cl AS (SELECT image_id, opened, count(*) = 6 AS whole, CASE WHEN count(*) = 6 THEN max(t) ELSE opened + 7200000000 END AS closed FROM ce GROUP BY image_id, opened),
nx AS (SELECT cl.*, (SELECT min(t) FROM ev WHERE ev.image_id = cl.image_id AND t > closed) AS next FROM cl),
im AS (SELECT nx.* FROM nx JOIN (SELECT image_id, min(t) AS opened FROM ev GROUP BY image_id) USING (image_id, opened) UNION ALL SELECT nx.* FROM im JOIN nx ON nx.image_id = im.image_id AND nx.opened = im.next)
SELECT image_id, y, x, opened, closed, whole, round(CAST(l AS DOUBLE), 5) + 0.0 AS l FROM im JOIN ce USING (image_id, opened) WHERE (closed + 999) // 1000 <= (SELECT max(t) FROM ev) // 1000 - 86400000""",
)
