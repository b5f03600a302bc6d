"""Shards of near equal bytes by balanced label propagation over documents linked by equal text.

Every document starts in a shard dealt by its id, those of groups over a quarter of a shard first. In each round a join sends each part of a group
(its documents in one shard) towards the shard where most of its neighbours are, as far as the quota
of bytes that the shard has room for, or gives away in the same round, allows. What has no link fills the shards up to the same
size in the end, so the cut stays small and the sizes even: two shards differ by about one document.

Scale: rounds work on (group, shard, count) rows, at most one for each linked document and 16 for
the largest group; a group of any size is spread by sums, never gathered. Ranks and running sums go
in two steps (within buckets of bounded size, then over the bucket totals). Only sums by shard reach
the driver.

Defined results: null and empty texts have size 1, checksum 0 and form one group; repeated rows are
documents of their own; groups larger than a shard spread over several; an empty table gives an
empty result; very long texts count as one document; other columns are ignored. Groups are keyed by a 64-bit hash: a collision would only
put two unlike texts side by side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable

SHARDS = 16
BUCKET_ROWS = 100_000
HOT_GROUPS = 1000


def _running(df: DataFrame, keys: list[str], value: Column, order: list[str], name: str, buckets: int) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over earlier rows of the same keys, in an order by buckets hashed anew for each ``name``."""
    df = df.withColumn("_b", F.pmod(F.xxhash64(F.lit(name), order[0]), F.lit(buckets))).withColumn("_v", value)
    totals = df.groupBy(*keys, "_b").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*keys or [F.lit(0)]).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    own = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_r", F.coalesce(F.sum("_v").over(own), F.lit(0))).join(offsets, [*keys, "_b"]).withColumn(name, F.col("_r") + F.col("_o")).drop("_b", "_v", "_r", "_o")


def _of_group(df: DataFrame, groups: DataFrame, values: DataFrame) -> DataFrame:
    """Left join of documents with a row per group. Groups that hold over a thousandth of all documents, fewer than
    ``HOT_GROUPS``, are broadcast; what is left to shuffle has no larger key."""
    hot = groups.where("hot").select("g")
    few = F.broadcast(values.join(F.broadcast(hot), "g", "left_semi"))
    return df.join(F.broadcast(hot), "g", "left_semi").join(few, "g").unionByName(df.join(F.broadcast(hot), "g", "left_anti").join(values, "g", "left"))


def _exchange(want: dict[tuple[int, int], float], room: dict[int, float], rounds: int = 200) -> dict[tuple[int, int], float]:
    """The share of each wanted move (from, to) that may go: a shard takes in what it has room for and what it gives away."""
    go = dict(want)
    for _ in range(rounds):
        into: dict[int, float] = {}
        out: dict[int, float] = {}
        for (a, b), v in go.items():
            into[b] = into.get(b, 0.0) + v
            out[a] = out.get(a, 0.0) + v
        scale = {b: min(1.0, (room[b] + out.get(b, 0.0)) / v) for b, v in into.items() if v}
        if min(scale.values(), default=1.0) > 0.999:
            break
        go = {(a, b): v * scale.get(b, 1.0) for (a, b), v in go.items()}
    return {k: go[k] / v for k, v in want.items() if v}


def _loads(parts: DataFrame) -> dict[int, float]:
    return {r.shard: float(r.bytes) for r in parts.groupBy("shard").agg(F.sum(F.col("n") * F.col("size")).alias("bytes")).collect()}  # a row for each shard


def propagate(parts: DataFrame, capacity: float, shards: int = SHARDS, rounds: int = 16, settled: float = 0.001, held: dict[int, float] | None = None) -> DataFrame:
    """Parts (g, shard, n, size) of groups after moves towards the heaviest part that may take more.

    A round ends the propagation when it moves less than ``settled`` of all linked documents. A shard that takes
    next to nothing is passed over until it has or makes room, so groups larger than a shard fill others. ``held``
    are bytes of each shard that stay.
    """
    closed: set[int] = set()
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    for k in range(rounds):
        load = _loads(parts)
        room = {s: max(0.0, capacity - load.get(s, 0.0) - (held or {}).get(s, 0.0)) for s in range(shards)}
        near = parts.select("g", F.col("shard").alias("to"), F.col("n").alias("n_to")).where(~F.col("to").isin(sorted(closed)))
        heavier = (F.col("n_to") > F.col("n")) | ((F.col("n_to") == F.col("n")) & (F.col("to") < F.col("shard")))
        moves = durable(parts.join(near, "g").where((F.col("to") != F.col("shard")) & heavier).groupBy("g", "shard", "n", "size").agg(F.max_by("to", F.struct("n_to", -F.col("to"))).alias("to")))
        want = {(r.shard, r.to): float(r.bytes) for r in moves.groupBy("shard", "to").agg(F.sum(F.col("n") * F.col("size")).alias("bytes")).collect()}  # a row for each pair of shards
        share = _exchange(want, room)
        of_pair = F.element_at(F.array(*[F.lit(float(share.get((a, b), 0.0))) for a in range(shards) for b in range(shards)]), F.col("shard") * shards + F.col("to") + 1)
        chance = F.pmod(F.xxhash64("g", "shard", F.lit(k)), F.lit(1 << 20)) / float(1 << 20)
        moved = moves.withColumn("m", F.least("n", F.floor(F.col("n") * of_pair + chance))).where("m > 0")
        change = moved.select("g", "shard", (-F.col("m")).alias("n"), "size").union(moved.select("g", F.col("to").alias("shard"), F.col("m").alias("n"), "size"))
        parts = durable(parts.select("g", "shard", "n", "size").union(change).groupBy("g", "shard").agg(F.sum("n").alias("n"), F.max("size").alias("size")).where("n > 0"))
        into, asked, gave = dict.fromkeys(range(shards), 0.0), dict.fromkeys(range(shards), 0.0), dict.fromkeys(range(shards), 0.0)
        for (a, b), v in want.items():
            asked[b] += v
            into[b] += v * share.get((a, b), 0.0)
            gave[a] += v * share.get((a, b), 0.0)
        full = {b for b in range(shards) if into[b] < 0.05 * asked[b]}
        if (moved.agg(F.sum("m")).first()[0] or 0) <= settled * total and full <= closed:
            break
        closed = {b for b in closed | full if max(room[b] - into[b], gave[b]) < 0.01 * capacity}
    return parts


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, **options) -> DataFrame:
    """One row per document: id, ``size``, ``text_crc32``, ``shard`` and ``slot`` (0, 1, ... within the shard)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = durable(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("g")))
    rows, total = base.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets, capacity = max(64, math.ceil(rows / BUCKET_ROWS)), total / shards

    groups = durable(base.groupBy("g").agg(F.count("*").alias("c")).where("c > 1").withColumn("hot", F.col("c") * HOT_GROUPS > rows))
    named = _of_group(base, groups, groups.select("g", "hot"))
    linked, single = named.where("hot IS NOT NULL").drop("hot"), named.where("hot IS NULL").drop("hot")
    start = F.pmod(F.xxhash64("id", "crc"), F.lit(shards)).cast("int")
    parts = durable(linked.withColumn("shard", start).groupBy("g", "shard").agg(F.count("*").alias("n"), F.max("size").alias("size")))
    # groups over a quarter of a shard, 4 x shards at most, settle first; the others start where these leave room
    large = parts.groupBy("g").agg(F.sum(F.col("n") * F.col("size")).alias("bytes")).where(F.col("bytes") > capacity / 4).select("g")
    first = durable(propagate(durable(parts.join(F.broadcast(large), "g", "left_semi")), capacity, shards, **options))
    held = _loads(first)
    slots = _slots([max(0.0, capacity - held.get(s, 0.0)) for s in range(shards)])
    anew = F.element_at(F.array(*map(F.lit, slots)), (F.pmod(F.xxhash64("id", "crc", F.lit(1)), F.lit(len(slots))) + 1).cast("int"))
    rest = linked.join(F.broadcast(large), "g", "left_anti").withColumn("shard", anew).groupBy("g", "shard").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    parts = first.select("g", "shard", "n", "size").union(propagate(durable(rest), capacity, shards, held=held, **options).select("g", "shard", "n", "size"))
    parts = durable(parts)

    # the documents of a group, in order, to its parts
    by_group = Window.partitionBy("g").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    spans = parts.withColumn("hi", F.sum("n").over(by_group)).groupBy("g").agg(F.collect_list(F.struct("shard", (F.col("hi") - F.col("n")).alias("lo"), "hi")).alias("spans"))  # a group has one part in each shard at most
    ranked = _running(linked, ["g"], F.lit(1), ["id", "crc"], "rank", buckets)
    own = F.filter("spans", lambda x: (x["lo"] <= F.col("rank")) & (F.col("rank") < x["hi"]))[0]["shard"]
    placed = _of_group(ranked, groups, spans).select("id", "size", "crc", own.alias("shard"))
    placed = durable(_running(placed, ["shard"], F.col("size"), ["id", "crc"], "at", buckets))

    # beyond the capacity a linked document fills gaps like those without links
    fits = F.col("at") + F.col("size") <= capacity
    kept = placed.where(fits).select("id", "size", "crc", "shard")
    load = {r.shard: float(r.bytes) for r in kept.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
    filler = placed.where(~fits).select("id", "size", "crc").union(single.select("id", "size", "crc"))
    # large ones first, each shard to the same share of its gap; small ones then even the sizes out
    mean = total / max(1, rows)
    filler = durable(filler)
    small = filler.where(F.col("size") <= mean)
    left = small.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] / shards
    filled = durable(_fill(filler.where(F.col("size") > mean), load, capacity - left, shards, buckets))
    for r in filled.groupBy("shard").agg(F.sum("size").alias("bytes")).collect():
        load[r.shard] = load.get(r.shard, 0.0) + r.bytes
    whole = durable(kept.union(filled).union(_fill(small, load, capacity, shards, buckets)))
    return _running(whole, ["shard"], F.lit(1), ["id", "crc", "size"], "slot", buckets).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", F.col("slot").cast("long").alias("slot"))


def _slots(room: list[float], n: int = 512) -> list[int]:
    """``n`` shards, each as often as it has room."""
    total = sum(room)
    edges = [round(n * sum(room[: s + 1]) / total) if total else n * (s + 1) // len(room) for s in range(len(room))]
    return [s for s, (a, b) in enumerate(zip([0, *edges], edges, strict=False)) for _ in range(b - a)]


def cut_links(placed: DataFrame, group: str = "text_crc32", shard_col: str = "shard") -> DataFrame:
    """One row: ``links`` between rows of a group (pairs, by their number), and those ``cut`` by the border of a shard."""
    n = F.col("n").cast("double")
    parts = placed.groupBy(group, "size", shard_col).agg(F.count("*").alias("n"))
    groups = parts.groupBy(group, "size").agg(F.sum(n).alias("whole"), F.sum(n * n).alias("inside"))
    return groups.agg((F.sum(F.col("whole") * (F.col("whole") - 1)) / 2).alias("links"), (F.sum(F.col("whole") * F.col("whole") - F.col("inside")) / 2).alias("cut"))


def _fill(filler: DataFrame, load: dict[int, float], capacity: float, shards: int, buckets: int) -> DataFrame:
    """``filler`` with ``shard``: its running sum of sizes runs through the gaps that the loads leave, shard by shard."""
    edge, gap = 0.0, F.lit(0)
    for s in range(shards - 1):
        edge += max(0.0, capacity - load.get(s, 0.0))
        gap = gap + (F.col("at") + F.col("size") / 2 >= edge).cast("int")
    filler = _running(filler, [], F.col("size"), ["id", "crc"], "at", buckets)
    return filler.select("id", "size", "crc", gap.cast("int").alias("shard"))


def digest(docs: DataFrame) -> DataFrame:
    """The report of the query: one row per document."""
    return shard(docs.select("doc_id", "text")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
