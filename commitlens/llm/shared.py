"""Cutting lineage, numbering rows, bounded broadcasts and connected components, without anything local to one machine."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of ids (or of a few numbers) that are sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Bytes of strings among them at most.
BROADCAST_BYTES = 32 << 20
#: Bits of a row's number inside its partition, in ``monotonically_increasing_id``.
_INSIDE = 33


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a folder of this machine, which only a local master accepts."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not sc.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="checkpoint-")


def cut(df: DataFrame) -> DataFrame:
    """The rows, kept in the shared folder, with no lineage."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files and checkpoints that nothing refers to any more.

    Spark's cleaner follows the driver's garbage collection, which may not come
    for an hour while executors' disks fill with shuffles that a cut has replaced.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame) -> DataFrame:
    """``df``, which is already cut, with a hint to broadcast it if it has at most ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` bytes in strings and lists."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    if {"map", "struct"} & set(kinds.values()):
        return df
    wide = [F.octet_length(n) for n, k in kinds.items() if k in ("string", "binary")] + [8 * F.size(n) for n, k in kinds.items() if k == "array"]
    rows, held = df.agg(F.count("*"), sum((F.coalesce(F.sum(w), F.lit(0)) for w in wide), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and held <= BROADCAST_BYTES else df


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The rows in their present order with a number (0, 1, 2, ...) in the long column ``name``.

    The number inside a partition, and the sizes of the partitions before: one row for each partition in the
    window without a key.
    """
    held = cut(df.withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, _INSIDE)
    sizes = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", before.alias("_before"))
    at = F.col(name).bitwiseAND((1 << _INSIDE) - 1) + F.col("_before")
    return held.join(F.broadcast(sizes), part == F.col("_part")).select(*df.columns, at.alias(name))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id isn't in ``ids`` (one column); rows without an id stay."""
    ids = cut(ids.toDF("doc_id").where("doc_id is not null").distinct())
    return docs.join(small(ids), "doc_id", "left_anti").select(*docs.columns)


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """a, b -> node, component: the least node that links reach, for all nodes of the edges.

    Least labels spread over links and then jump to their label's label, so
    the rounds follow the logarithm of a component's width. Every step is a
    shuffle of the links or of the labels; hubs are met by partial minima.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).where("u <> v").distinct()
    both = cut(both)
    # The labels are no more than the links.
    near_all = F.broadcast if both.count() <= BROADCAST_ROWS else lambda df: df
    labels = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("component"))
    labels = cut(labels)
    for _ in range(rounds):
        near = both.join(near_all(labels), both["u"] == labels["node"]).groupBy(F.col("v").alias("node")).agg(F.min("component").alias("near"))
        spread = near.join(near_all(labels), "node").select("node", "component", F.least("component", "near").alias("near"))
        target = spread.select(F.col("node").alias("to"), F.col("near").alias("far"))
        jumped = spread.join(near_all(target), F.col("near") == F.col("to")).select("node", F.least("near", "far").alias("component"), F.col("component").alias("was"))
        jumped = cut(jumped)
        moved = jumped.where("component <> was").limit(1).count()
        labels = jumped.drop("was")
        if not moved:
            return labels
    raise RuntimeError("labels still move after the last round")
