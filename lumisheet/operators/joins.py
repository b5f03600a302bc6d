"""As-of and range joins of image and event tables (extensions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..schema import require_channels
from .ranks import TOP, radix


def _bucket(df: DataFrame, ts: str, seconds: int) -> Column:
    """A number that never falls as time goes on: instants count from the epoch, times without a zone by their own calendar."""
    t = F.col(ts)
    if df.schema[ts].dataType == T.TimestampNTZType():
        since = F.unix_date(t.cast("date")).cast("long") * 86_400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    else:
        since = F.floor(F.unix_micros(t.cast("timestamp")) / F.lit(1_000_000))
    return F.floor(since / F.lit(seconds)).cast("long")


def asof_join(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, seconds: int = 86_400) -> DataFrame:
    """``left`` with the latest ``right`` row of the same ``key`` at or before its ``ts``: columns ``value`` and ``<value>_ts``.

    No self join: rows of both sides are dealt by (key, bucket of ``seconds``) and the last value is taken in the order of
    time. What a bucket takes over from earlier ones comes from one row for each key and bucket, the last value of the buckets
    before, which enters the bucket ahead of all others. So a key with any share of the rows is as many groups as
    it has buckets, and what meets by key alone is a row for each bucket.

    Of rows of ``right`` with one key and time the largest ``value`` counts. NULL values of ``right`` are values. Rows of ``left``
    without key or time, and those before any of ``right``, get NULLs; rows of ``right`` without them are no match for any.
    """
    at = f"{value}_ts"
    kept = [c for c in left.columns if c not in (value, at)]
    mark = F.struct(F.col(ts).alias("at"), F.col(value).alias("value"))
    settings = right.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("_key"), _bucket(right, ts, seconds).alias("_bucket"), F.col(ts).alias("_ts"), mark.alias("_mark"))
    whole = F.col(key).isNotNull() & F.col(ts).isNotNull()
    rows = left.where(whole).select(F.col(key).alias("_key"), _bucket(left, ts, seconds).alias("_bucket"), F.col(ts).alias("_ts"), F.struct(*kept).alias("_row"))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    # the last value of each key and bucket, and the last before each bucket that holds rows
    per = settings.groupBy("_key", "_bucket").agg(F.max("_mark").alias("_mark")).unionByName(rows.select("_key", "_bucket", none(settings, "_mark")).distinct()).groupBy("_key", "_bucket").agg(F.max("_mark").alias("_mark"))
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select("_key", "_bucket", F.last("_mark", ignorenulls=True).over(before).alias("_mark")).where("_mark is not null")
    carried = carried.select("_key", "_bucket", none(settings, "_ts"), "_mark", none(rows, "_row"), F.lit(0).alias("_turn"))
    own = settings.select("_key", "_bucket", "_ts", "_mark", none(rows, "_row"), F.lit(1).alias("_turn"))
    asked = rows.select("_key", "_bucket", "_ts", none(settings, "_mark"), "_row", F.lit(2).alias("_turn"))
    order = Window.partitionBy("_key", "_bucket").orderBy(F.col("_ts").asc_nulls_first(), "_turn", "_mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = carried.unionByName(own).unionByName(asked).withColumn("_last", F.last("_mark", ignorenulls=True).over(order)).where("_turn = 2")
    found = told.select(*[F.col("_row").getField(c).alias(c) for c in kept], F.col("_last.value").alias(value), F.col("_last.at").alias(at))
    missed = left.where(~whole).select(*kept, none(right, value), F.lit(None).cast(right.schema[ts].dataType).alias(at))
    return found.unionByName(missed)


#: Buckets grow by this factor from level to level; a band stands in at most so many and one more.
STEP, LEVELS = 256, 3


def range_join(points: DataFrame, value: str, bands: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """All pairs of ``points`` and ``bands`` with ``low <= value < high``, by an equality join of buckets.

    A band goes to the finest of three levels of buckets (``width`` wide, 256 times that, and 65,536 times that) in which it
    touches at most 257 of them, else, as any that is open on a side (NULL or infinite), to one bucket for all. A point
    stands in one bucket of each level, so a pair meets once, and both sides are copied a bounded number of times. Spark
    broadcasts ``bands`` if they are within its size limit, and shuffles by (level, bucket) else, where adaptive
    execution splits buckets that hold many points.

    Empty bands and values that are NULL or NaN match nothing; columns of both sides are kept and must have different names.
    """
    infinite = float("inf")
    lo, hi = F.coalesce(F.col(low).cast("double"), F.lit(-infinite)), F.coalesce(F.col(high).cast("double"), F.lit(infinite))
    widths = [float(width) * STEP**k for k in range(LEVELS)]
    at = lambda v, w: F.floor(v / F.lit(w)).cast("long")
    closed = (F.abs(lo) < infinite) & (F.abs(hi) < infinite) & (F.greatest(F.abs(lo), F.abs(hi)) < F.lit(2.0**62 * widths[0]))
    level = F.lit(LEVELS)
    for k in reversed(range(LEVELS)):
        level = F.when(closed & (hi - lo <= STEP * widths[k]), F.lit(k)).otherwise(level)
    spans = F.lit(None).cast("array<long>")
    for k, w in enumerate(widths):
        spans = F.when(F.col("_level") == k, F.sequence(at(lo, w), at(hi, w))).otherwise(spans)
    sound = bands.where(lo < hi).withColumn("_level", level)
    dealt = sound.withColumn("_bucket", F.explode(F.when(F.col("_level") == LEVELS, F.array(F.lit(0).cast("long"))).otherwise(spans)))
    v = F.col(value).cast("double")
    near = F.abs(v) < F.lit(2.0**62 * widths[0])
    places = [F.struct(F.lit(k).alias("_level"), F.when(near, at(v, w)).alias("_bucket")) for k, w in enumerate(widths)]
    places.append(F.struct(F.lit(LEVELS).alias("_level"), F.lit(0).cast("long").alias("_bucket")))
    stands = points.where(v.isNotNull() & ~F.isnan(v)).select("*", F.explode(F.array(*places)).alias("_place")).select(*points.columns, "_place._level", "_place._bucket")
    return stands.join(dealt, ["_level", "_bucket"]).where((v >= lo) & (v < hi)).drop("_level", "_bucket")


def _step(v: Column) -> Column:
    """The least FLOAT, as DOUBLE, that is not below the DOUBLE ``v``; beyond all finite ones 2^128 stands for them."""
    size = F.abs(v)
    two = lambda p: F.pow(F.lit(2.0), p.cast("double"))
    guess = F.floor(F.log2(size))
    power = guess + F.when(two(guess) > size, -1).when(two(guess + 1) <= size, 1).otherwise(0)
    unit = two(F.greatest(power, F.lit(-126)) - 23)
    return F.when(size == 0, F.lit(0.0)).when(size < 2.0**128, F.ceil(v / unit) * unit + 0.0).when(size < float("inf"), F.signum(v) * F.lit(2.0**128)).otherwise(v)


def band_sums(points: DataFrame, value: str, bands: DataFrame, low: str, high: str) -> DataFrame:
    """``bands`` with the number ``n`` and the sum ``total`` (DOUBLE, NULL if none) of ``value`` over the ``points`` in each.

    The aggregates of ``range_join`` by its rules (``low <= value < high``, NULL bounds are open, NaN is above all, NULL and
    NaN values are in none), without its pairs: work grows with the points plus the bands. Points and bounds are counted by
    value, map-side, and what lies below a bound is the running sum of its radix bucket (65,536 unlike values at most), of the
    buckets before it in its power of two (128 at most), and of the powers between the two bounds of a band (some
    570, one row). ``value`` is FLOAT, so sums within a power of two are whole numbers of its last place: their
    differences are exact, and no large value takes digits from bands that don't hold it.
    """
    require_channels(points, value, keys=False)
    infinite = float("inf")
    dealt = bands.withColumns({"_low": _step(F.coalesce(F.col(low).cast("double"), F.lit(-infinite))), "_high": _step(F.coalesce(F.col(high).cast("double"), F.lit(infinite)))})
    v = F.col(value).cast("double") + 0.0  # one zero
    asked = dealt.select(F.explode(F.array("_low", "_high")).alias("_v")).distinct()
    rows = points.where(v.isNotNull() & ~F.isnan(v)).select(v.alias("_v"), F.lit(1).alias("_n"), F.lit(False).alias("_asked")).unionByName(asked.select("_v", F.lit(0).alias("_n"), F.lit(True).alias("_asked")))
    power = (F.signum("_bucket") * F.floor(F.abs("_bucket") / 128)).cast("int")
    edge = TOP // 128  # infinite values count as one, times infinity
    unit = lambda p: F.when(F.abs(p) >= edge, F.lit(infinite)).otherwise(F.pow(F.lit(2.0), F.abs(p) - F.lit(183.0)))
    places = F.when(F.abs("_power") >= edge, F.signum("_power")).otherwise(F.col("_v") / unit(F.col("_power"))).cast("long")

    cells = rows.groupBy("_v").agg(F.sum("_n").alias("_n"), F.max("_asked").alias("_asked")).withColumn("_bucket", radix(F.col("_v"))).withColumn("_power", power)
    cells = cells.withColumn("_s", F.when(F.col("_n") > 0, F.col("_n") * places).otherwise(0))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    below = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    inside = before.partitionBy("_bucket").orderBy("_v")
    found = cells.select("_v", "_asked", "_bucket", below("_n", inside).alias("_n"), below("_s", inside).alias("_s")).where("_asked")
    held = cells.groupBy("_bucket", "_power").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    earlier = before.partitionBy("_power").orderBy("_bucket")
    offsets = held.select("_bucket", "_power", below("_n", earlier).alias("_n0"), below("_s", earlier).alias("_s0"))
    found = found.join(offsets, "_bucket").select("_v", F.struct("_power", (F.col("_n") + F.col("_n0")).alias("n"), (F.col("_s") + F.col("_s0")).alias("s")).alias("_at"))
    powers = held.groupBy("_power").agg(F.sum("_n").alias("n"), F.sum("_s").alias("s")).agg(F.sort_array(F.collect_list(F.struct("_power", "n", "s"))).alias("_powers"))

    ends = dealt.join(found.select(F.col("_v").alias("_low"), F.col("_at").alias("_from")), "_low").join(found.select(F.col("_v").alias("_high"), F.col("_at").alias("_to")), "_high").crossJoin(F.broadcast(powers))

    def share(p: Column) -> Column:
        """What a band holds of a power of two: its number and its sum."""
        n, s = (F.when(p["_power"] < F.col("_to._power"), p[c]).otherwise(F.col(f"_to.{c}")) - F.when(p["_power"] == F.col("_from._power"), F.col(f"_from.{c}")).otherwise(0) for c in ("n", "s"))
        return F.struct(n.alias("n"), F.when(n > 0, s * unit(p["_power"])).otherwise(0.0).alias("s"))

    within = F.filter("_powers", lambda p: (p["_power"] >= F.col("_from._power")) & (p["_power"] <= F.col("_to._power")) & (F.col("_low") < F.col("_high")))
    shares = ends.withColumn("_shares", F.transform(within, share))
    n = F.aggregate("_shares", F.lit(0).cast("long"), lambda a, p: a + p["n"])
    total = F.aggregate("_shares", F.lit(0.0), lambda a, p: a + p["s"])
    return shares.select(*bands.columns, n.alias("n"), total.alias("total")).withColumn("total", F.when(F.col("n") > 0, F.col("total")))
