"""Near-duplicate vectors by an exact metric range join.

Unit vectors with cosine >= c lie within r = sqrt(2 - 2c) of each other. Large labels get pivots; a
vector's home is the cell of its nearest pivot, and it visits each cell before its home that may hold a vector
within r. By the triangle inequality that is a cell q with d(x, q) <= R + r, R being the radius of the cell, and
for none of the pivots s near x does x lie farther than r behind the plane midway between q and s, as
all of the cell lies before it. Cells then join on their own: a link is found once, in the lower of the two homes.

Scale: equal vectors of a label are one class with a count, so copies cost nothing. The first level has at most
``max_pivots`` pivots in all, chosen by hash, which all tasks share; of ``PROBES`` vectors of a label it is measured how
many cells a vector visits, and the number of pivots with the least work among those with few visits is taken. Each
further level takes the cells with more than ``wide_rows`` members at home and parts each by pivots of its own, at most
``max_pivots`` a cell, fitted cell by cell in tasks: they travel to the blocks of their cell by a shuffle, and the
driver sees none. A label that got no pivots at first is one cell, so every large label is served. There a member at
home visits the cells before its new home as above, and a guest each cell that may hold a partner at home; guests
never meet each other. Pivots set the cost, never the result. A cell of any size is cut into blocks of ``block_rows``
members; home blocks meet all blocks in groups of their own, in products of bounded size. A group emits counts and a spanning forest of its links, not the links, and classes carry their least id,
so no component is gathered. Where vectors spread evenly over many dimensions every cell is visited by most
vectors, and the join nears the blocked comparison of a label with itself; that is the nature of the metric, not
a limit on rows. Pairs in a cell are compared by one matrix product, which costs less than bounds by further pivots.

Defined results: vectors that are null, zero, or hold a null or non-finite component, and those
without a label, link with nothing; vectors of different length never link; repeated rows are vectors
of their own; vectors without id link, but name no component while another does; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import components, durable
from .simhash import forest

COSINE = 0.93
PROBES = 64
#: Cells that a vector may visit, on average, for a finer partition to be taken.
VISITS = 4.0
#: Pivots nearest to a vector against which the planes of a cell are tried, and numbers in a product at once.
PLANES, PRODUCT = 8, 1 << 22


def _unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a column of lists of one length, scaled to length one."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def visited(x: np.ndarray, pivots: np.ndarray, radius: float, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The home of each vector, and a table of the cells that may hold a vector within ``radius`` of it, home apart."""
    square = np.maximum(0, 2 - 2 * x @ pivots.T)
    home = square.argmin(axis=1)
    out = np.ones(square.shape, bool) if reach is None else np.sqrt(square) <= reach + radius + 1e-9
    between = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
    near = np.argpartition(square, min(PLANES, square.shape[1]) - 1, axis=1)[:, :PLANES]
    for k in range(near.shape[1]):
        s = near[:, k]
        out &= square - square[np.arange(len(x)), s][:, None] <= 2 * radius * between[s] + 1e-9
    out[np.arange(len(x)), home] = False
    return home, out


def _number(pivots: np.ndarray, probes: np.ndarray, radius: float, good: Callable[[int, float], bool]) -> int:
    """How many of the pivots make the least work, of those numbers that are ``good`` by the cells a probe visits; 0 if none is."""
    best, least, n = 0, None, len(pivots)
    while n >= 2 and len(probes):
        home, cells = visited(probes, pivots[:n], radius)
        visits = 1 + float((cells & (np.arange(n) < home[:, None])).sum(axis=1).mean())
        work = visits / n  # compared rows are the members of a cell times its own
        if good(n, visits) and (least is None or work < least):
            best, least = n, work
        n //= 2
    return best


def _pivots(classes: DataFrame, radius: float, cell_rows: int, wide_rows: int, max_pivots: int) -> dict[tuple, np.ndarray]:
    """Pivots of each large label and vector length; ``max_pivots`` in all at most."""
    sizes = classes.groupBy("label", "dims").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows).orderBy(F.desc("n"), "label", "dims").limit(max_pivots // 2).collect()
    total = sum(r.n for r in sizes)
    quota = {(r.label, r.dims): max(2, min(-(-r.n // cell_rows), (max_pivots - 2 * len(sizes)) * r.n // total + 2)) for r in sizes}
    if not quota:
        return {}
    spark = classes.sparkSession
    size = {(r.label, r.dims): r.n for r in sizes}
    schema = T.StructType([*classes.select("label", "dims").schema.fields, T.StructField("want", T.IntegerType()), T.StructField("rate", T.DoubleType())])
    want = F.broadcast(spark.createDataFrame([(*k, n + PROBES, 40 * (n + PROBES) / size[k]) for k, n in quota.items()], schema))
    # a thin hash sample of each label (about 40 for each pivot), of which the first by hash are taken
    u = (F.pmod(F.xxhash64(F.lit(1), "cid"), F.lit(1 << 30)) / float(1 << 30)).alias("u")
    thin = classes.select("label", "dims", "v", u).join(want, ["label", "dims"]).where(F.col("u") <= F.col("rate"))
    first = thin.withColumn("k", F.row_number().over(Window.partitionBy("label", "dims").orderBy("u"))).where(F.col("k") <= F.col("want"))
    found: dict[tuple, list] = {}
    for r in first.select("label", "dims", "v").orderBy("label", "dims", "k").collect():  # max_pivots rows, and PROBES for each of these labels
        found.setdefault((r.label, r.dims), []).append(r.v)
    out = {}
    for key, rows in found.items():
        x = _unit(pa.array(rows))
        pivots, probes = x[: quota[key]], x[quota[key] :]
        out[key] = pivots[: _number(pivots, probes, radius, lambda n, visits, at=key: visits <= VISITS or size[at] > n * wide_rows) or 1]
    return out


def _by_label(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray, pa.RecordBatch]]:
    """Rows of a batch (its first columns are label and dims) by label and length."""
    groups: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
        groups.setdefault(key, []).append(i)
    for key, rows in groups.items():
        yield key, np.array(rows), batch.take(pa.array(rows, pa.int64()))


def range_links(classes: DataFrame, cosine: float = COSINE, cell_rows: int = 1024, wide_rows: int = 1 << 15, block_rows: int = 1 << 14, max_pivots: int = 512, levels: int = 3) -> DataFrame:
    """Links between classes (label, dims, v, cid, id, c): rows (cid, id, n, other, other_id), n partial counts of linked vectors of
    other classes, ``other`` an edge of the spanning forest (itself: none)."""
    members = durable(route(classes, cosine, cell_rows, wide_rows, max_pivots))
    for level in range(2, levels + 1):
        if (finer := _refined(members, cosine, cell_rows, wide_rows, block_rows, max_pivots, level)) is None:
            break
        members = finer
    key = ["label", "dims", "cell"]
    count = lambda home: F.ceil(F.count(F.when(F.col("home") == home, True)) / block_rows).cast("int")
    sizes = members.groupBy(*key).agg(count(True).alias("homes"), count(False).alias("guests"), (F.count("*") <= block_rows).alias("whole"))
    cut = members.join(sizes.where("homes > 0"), key)
    hashed = lambda n: F.pmod(F.xxhash64("cid"), F.greatest(n, F.lit(1))).cast("int")
    cut = cut.withColumn("k", F.when(F.col("whole"), 0).when(F.col("home"), hashed(F.col("homes"))).otherwise(F.col("homes") + hashed(F.col("guests"))))
    # a home block meets all blocks, a block of guests the home blocks
    last = F.when(F.col("whole"), 0).when(F.col("home"), F.col("homes") + F.col("guests") - 1).otherwise(F.col("homes") - 1)
    pairs = cut.withColumn("j", F.explode(F.sequence(F.lit(0), last))).withColumn("lo", F.least("k", "j")).withColumn("hi", F.greatest("k", "j"))
    pairs = pairs.select(*key, "lo", "hi", "k", "home", "cid", "id", "c", "v")

    def link(rows: pa.Table) -> pa.Table:
        home, cid = rows.column("home").to_numpy(), rows.column("cid").to_numpy()
        order = np.lexsort((cid, ~home))
        rows = rows.take(pa.array(order))
        home, cid, c, k = (rows.column(x).to_numpy() for x in ("home", "cid", "c", "k"))
        one = rows.column("lo")[0] == rows.column("hi")[0]
        x, own = _unit(rows.column("v")), np.count_nonzero(home)
        n = np.zeros(len(x), np.int64)

        def linked() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            step = max(1, PRODUCT // len(x))
            for i in range(0, own, step):
                near = x[i : min(own, i + step)] @ x[i:].T
                a, b = np.nonzero(near >= cosine - 1e-12)
                close = np.abs(near[a, b] - cosine) < 1e-12
                a, b = a + i, b + i
                good = (a < b) & (one | (k[a] != k[b]))  # pairs within a block have a group of their own
                for e in np.flatnonzero(close & good).tolist():  # the plain formula decides at the edge
                    p, q = (np.asarray(rows.column("v")[int(r)].as_py(), float) for r in (a[e], b[e]))
                    good[e] = float(p @ q) / (float(np.linalg.norm(p)) * float(np.linalg.norm(q))) >= cosine
                a, b = a[good], b[good]
                np.add(n, np.bincount(a, c[b], len(x)).astype(np.int64), out=n)
                np.add(n, np.bincount(b, c[a], len(x)).astype(np.int64), out=n)
                yield a, b

        root = forest(len(x), linked())
        keep = (n > 0) | (root != np.arange(len(x)))
        key = rows.column("id").combine_chunks() if rows.num_rows else rows.column("id")
        return pa.table({"cid": cid[keep], "id": key.take(pa.array(np.flatnonzero(keep))), "n": n[keep], "other": cid[root[keep]], "other_id": key.take(pa.array(root[keep]))})

    return pairs.groupBy(*key, "lo", "hi").applyInArrow(link, "cid long, id long, n long, other long, other_id long")


def _radius(cosine: float) -> float:
    return float(np.sqrt(2 - 2 * cosine)) + 1e-7


def _refined(members: DataFrame, cosine: float, cell_rows: int, wide_rows: int, block_rows: int, max_pivots: int, level: int) -> DataFrame | None:
    """``members`` with the cells above ``wide_rows`` parted by pivots of their own; None if no cell is parted.

    A cell stays whole where its vectors would visit so many parts that the blocks of the cell are the lesser copies.
    """
    radius, key = _radius(cosine), ["label", "dims", "cell"]
    sizes = durable(members.groupBy(*key).agg(F.count(F.when(F.col("home"), True)).alias("rows"), F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")).where(F.col("rows") > wide_rows))
    if sizes.isEmpty():
        return None
    want = F.least(F.ceil(F.col("rows") / cell_rows), F.lit(max_pivots)).cast("int")
    # a thin hash sample of each cell (about two rows for each one wanted), of which the first by hash are taken
    u = F.pmod(F.xxhash64(F.lit(level), "cid"), F.lit(1 << 30)) / float(1 << 30)
    thin = members.where("home").join(sizes.withColumn("want", want), key).withColumn("u", u).where(F.col("u") * F.col("rows") <= 2 * (F.col("want") + PROBES))
    first = thin.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("u", "cid"))).where(F.col("k") <= F.col("want") + PROBES)

    def fit(sample: pa.Table) -> pa.Table:
        sample = sample.sort_by("k")
        x, quota, rows = _unit(sample.column("v")), sample.column("want")[0].as_py(), sample.column("rows")[0].as_py()
        n = _number(x[:quota], x[quota:], radius, lambda n, visits: visits <= max(VISITS, rows / block_rows))
        return sample.slice(0, n).select([*key, "k", "v"])

    fields = {f.name: f for f in members.schema.fields}
    pivots = durable(first.select(*key, "k", "v", "want", "rows").groupBy(*key).applyInArrow(fit, T.StructType([*(fields[c] for c in key), T.StructField("k", T.IntegerType()), fields["v"]])))
    parted = durable(sizes.join(pivots.select(*key).distinct(), key).select(*key, "blocks"))
    if parted.isEmpty():
        return None
    names = members.columns

    def send(rows: pa.Table, own: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows.select(names)
        p = _unit(own.sort_by("k").column("v"))
        x, at_home, step = _unit(rows.column("v")), rows.column("home").to_numpy(), max(1, PRODUCT // 4 // len(p))
        at, to, home = [], [], []
        for i in range(0, len(x), step):
            mine = at_home[i : i + step]
            nearest, cells = visited(x[i : i + step], p, radius)
            cells &= ~mine[:, None] | (np.arange(len(p)) < nearest[:, None])
            cells[np.arange(len(mine)), nearest] = True
            a, b = np.nonzero(cells)
            at.append(a + i)
            to.append(b)
            home.append(mine[a] & (b == nearest[a]))
        at, to, home = (np.concatenate(c) for c in (at, to, home))
        sent = rows.select(names).take(pa.array(at))
        cell = rows.column("cell")[0].as_py() * (max_pivots + 1) + 1 + to
        sent = sent.set_column(names.index("cell"), "cell", pa.array(cell.astype(np.int64)))
        return sent.set_column(names.index("home"), "home", pa.array(home))

    block = F.pmod(F.xxhash64(F.lit(-level), "cid"), F.col("blocks")).cast("int")
    inside = members.join(parted, key).withColumn("block", block)
    copies = pivots.join(parted, key).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*key, "block", "k", "v")
    sent = inside.select(*names, "block").groupBy(*key, "block").cogroup(copies.groupBy(*key, "block")).applyInArrow(send, members.schema)
    whole = members.join(parted, key, "left_anti").withColumn("cell", F.col("cell") * (max_pivots + 1))
    return durable(whole.select(*names).union(sent))


def compared(members: DataFrame) -> DataFrame:
    """One row: ``pairs`` that the cells of routed members compare."""
    homes = F.count(F.when(F.col("home"), True)).cast("double")
    cells = members.groupBy("label", "dims", "cell").agg(homes.alias("h"), F.count("*").cast("double").alias("n"))
    return cells.agg(F.sum(F.col("h") * (F.col("h") - 1) / 2 + F.col("h") * (F.col("n") - F.col("h"))).alias("pairs"))


def route(classes: DataFrame, cosine: float, cell_rows: int, wide_rows: int, max_pivots: int) -> DataFrame:
    """``classes`` with ``cell`` and ``home``: a row for the home of each vector and for each cell before it that it visits."""
    radius = _radius(cosine)
    pivots = _pivots(classes, radius, cell_rows, wide_rows, max_pivots)
    columns = classes.select("label", "dims", "v", "cid", "id", "c")
    if not pivots:
        return columns.withColumn("cell", F.lit(0).cast("long")).withColumn("home", F.lit(True))
    sc = classes.sparkSession.sparkContext
    shared = sc.broadcast(pivots)

    def farthest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, _, own in _by_label(batch):
                if (p := shared.value.get(key)) is not None:
                    square = np.maximum(0, 2 - 2 * _unit(own.column(2)) @ p.T)
                    home = square.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(home.astype(np.int32)), pa.array(np.sqrt(square.min(axis=1)))], names=["label", "dims", "cell", "d"])

    keys = columns.select("label", "dims").schema.fields
    reach = {k: np.zeros(len(p)) for k, p in pivots.items()}
    by_cell = columns.select("label", "dims", "v").mapInArrow(farthest, T.StructType([*keys, T.StructField("cell", T.IntegerType()), T.StructField("d", T.DoubleType())])).groupBy("label", "dims", "cell").agg(F.max("d").alias("d"))
    for r in by_cell.collect():  # a row for each pivot
        reach[r.label, r.dims][r.cell] = r.d
    reached = sc.broadcast(reach)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, _, own in _by_label(batch):
                at, cell, home = np.arange(len(own)), np.zeros(len(own), np.int64), np.ones(len(own), bool)
                if (p := shared.value.get(key)) is not None:
                    cell, cells = visited(_unit(own.column(2)), p, radius, reached.value[key])
                    guest, to = np.nonzero(cells & (np.arange(len(p)) < cell[:, None]))
                    at, cell, home = np.concatenate((at, guest)), np.concatenate((cell, to)), np.arange(len(at) + len(guest)) < len(at)
                yield pa.RecordBatch.from_arrays([*own.take(pa.array(at)).columns, pa.array(cell.astype(np.int64)), pa.array(home)], names=["label", "dims", "v", "cid", "id", "c", "cell", "home"])

    return columns.mapInArrow(send, T.StructType([*columns.schema.fields, T.StructField("cell", T.LongType()), T.StructField("home", T.BooleanType())]))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id`` and ``kept``."""
    v = F.col(vector_col)
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = durable(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("v"), (finite & F.col(label_col).isNotNull()).alias("valid")))
    valid = rows.where("valid")
    classes = valid.groupBy("label", "v").agg(F.count("*").alias("c"), F.min("id").alias("id"))
    classes = durable(classes.withColumn("dims", F.size("v")).withColumn("cid", F.monotonically_increasing_id()))
    links = durable(range_links(classes, **options))
    vertex = lambda cid, key: F.struct(F.col(key).isNull().alias("none"), F.coalesce(key, F.lit(0)).alias("id"), F.col(cid).alias("cid"))  # noqa: E731  classes without id come last
    joined = components(links.where("other <> cid").select(vertex("cid", "id").alias("a"), vertex("other", "other_id").alias("b")))
    joined = joined.select(F.col("id.cid").alias("cid"), F.when(~F.col("label.none"), F.col("label.id")).alias("to"), F.lit(True).alias("linked"))
    counts = links.groupBy("cid").agg(F.sum("n").alias("n"))
    of = classes.select("label", "v", "cid", "id", "c").join(counts, "cid", "left").join(joined, "cid", "left")
    named = of.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("c") - 1).alias("n_links"), F.when(F.col("linked"), F.col("to")).otherwise(F.col("id")).alias("component_id"))
    linked = valid.join(named, ["label", "v"]).select("id", "n_links", "component_id")
    alone = rows.where(~F.col("valid")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def digest(vectors: DataFrame) -> DataFrame:
    """The report of the query: one row per vector."""
    return near_duplicates(vectors.select("vec_id", "embedding", "label"))


#: DuckDB: all pairs of a label.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
r(id, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.seen = l.a),
c AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN c ON c.id = vec_id
"""
