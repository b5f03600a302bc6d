"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, so that lost executors cost nothing.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset in a local session, as in
    tests, a temporary one is made. Spark removes the files of a result that is out of use where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # the shuffle files behind the checkpoint are of no more use, so they go at once
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def packed(docs: DataFrame, *apart: str) -> DataFrame:
    """``docs`` as the columns ``apart`` and ``_row``, a struct of all others, so that no new column meets one of theirs."""
    return docs.select(F.struct(F.lit(True).alias("_"), *[F.col(c) for c in docs.columns if c not in apart]).alias("_row"), *apart)


def unpacked(df: DataFrame, columns: list[str], *apart: str) -> DataFrame:
    """The columns that ``packed`` put away, in their order."""
    return df.select(*[F.col(c) if c in apart else F.col("_row").getField(c).alias(c) for c in columns])


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """Connected components of an undirected edge list.

    Labels start at the vertex itself; a round takes the least label of the neighbours, then the
    label of that label (pointer jumping), so chains shrink geometrically. Returns ``(id, label)``
    for each vertex on an edge, label being the least vertex of its component. Only counts of
    changed labels reach the driver; labels only fall, so the rounds end. Vertices may be of any type with an order. Hot vertices are fine: messages are pre-aggregated, and the
    joins are plain sort-merge joins, which adaptive execution splits where a key is skewed.
    """
    both = durable(
        edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
        .union(edges.select(F.col(dst).alias("u"), F.col(src).alias("v")))
        .where("u <> v")
        .distinct()
    )
    labels = durable(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("label")))
    while True:
        sent = both.join(labels, both.v == labels.id).select(F.col("u").alias("id"), "label")
        low = sent.groupBy("id").agg(F.min("label").alias("low"))
        hop = labels.join(low, "id", "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("low", "label")).alias("near"))
        up = labels.select(F.col("id").alias("near"), F.col("label").alias("far"))
        new = durable(hop.join(up, "near").select("id", F.least("near", "far").alias("label"), (F.least("near", "far") < F.col("old")).alias("moved")))
        labels = new.select("id", "label")
        if new.where("moved").limit(1).count() == 0:
            return labels
