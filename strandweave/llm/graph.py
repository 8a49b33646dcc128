"""Distributed connected components and checkpoints in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a checkpoint up to which it is read by few tasks, and how many; links up to which the driver follows them.
FEW_BYTES, FEW_TASKS, FEW_LINKS = 1 << 22, 8, 100_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where none is set (local tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="strandweave-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: computed once, its lineage cut, safe against lost executors.

    Shuffle files of plans that nothing refers to any more go when the driver's JVM collects
    its garbage; it is asked to, so that a long chain of steps doesn't keep them all.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    out = df.checkpoint(eager=True)
    spark.sparkContext._jvm.System.gc()
    return out


def compact(df: DataFrame) -> DataFrame:
    """:func:`cut`, and what is small is read by few tasks, however many wrote it.

    In a chain of many steps on small tables the tasks themselves are most of the work.
    """
    out = cut(df)
    spark = df.sparkSession
    path = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if path.isEmpty():
        return out
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.get())
    size = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return out.coalesce(FEW_TASKS) if size <= FEW_BYTES else out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever Hadoop's file systems have it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it as long as a column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id in ``edges``: the smallest id reachable.

    Alternates large-star and small-star steps: each links a node's neighbours to the
    least of them, by a minimum with partial aggregation and a join, so no neighbour list
    is ever gathered. Rounds grow with the logarithm of the longest path. Up to FEW_LINKS
    links are followed on the driver.
    """
    current = compact(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    if current.count() <= FEW_LINKS:
        return _followed(current)
    seen = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        current = cut(small)
        state = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")
        ).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    tops = current.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return current.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(tops)


def _followed(links: DataFrame) -> DataFrame:
    """:func:`connected_components` of few links (u, v), which the driver holds."""
    held = links.toArrow()
    ids, place = np.unique(np.concatenate([held["u"].to_numpy(), held["v"].to_numpy()]), return_inverse=True)
    u, v = place[: held.num_rows], place[held.num_rows :]
    top = np.arange(len(ids))
    while len(u):
        # trees: each root of a linked pair goes below the lesser one, then every row goes to its root
        a, b = top[u], top[v]
        if (a == b).all():
            break
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(top, top[top]):
            top = top[top]
    found = pa.table({"id": pa.array(ids.astype(np.int64)), "component": pa.array(ids[top].astype(np.int64))})
    return links.sparkSession.createDataFrame(found)


def neighbour_labels(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the least id within two steps of links, then that id's own least.

    One plan without rounds: equal labels are connected, connected ids may still differ.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v")))
    near = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    far = both.join(near.select(F.col("u").alias("v"), F.col("m").alias("l")), "v").groupBy("u").agg(F.min("l").alias("m"))
    return far.join(near.select(F.col("u").alias("m"), F.col("m").alias("top")), "m").select(F.col("u").alias("id"), F.col("top").alias("component"))
