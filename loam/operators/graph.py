"""Tables in the shared folder that cut lineage, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Where the setting is absent, a local session (tests) gets a temporary
    folder; on a cluster that is an error, as executors could not see it. What
    one application writes lies in a subfolder of its own, which clear() deletes.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="loam-"))
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/loam-{context.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application stored. Results that are still to
    be read or written need them, so this is for when those are done."""
    drop(spark, shared_folder(spark))


_SCOPES: ContextVar[tuple[str, ...]] = ContextVar("loam_scopes", default=())


@contextmanager
def scope(spark: SparkSession):
    """Tables that store() writes inside go when the block ends, but for those kept.

    For work whose result is stored in the block, so that nothing later reads what
    led to it.
    """
    scopes = _SCOPES.get()
    path = scratch(spark, "scope")
    token = _SCOPES.set((*scopes, path))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        drop(spark, path)


def scratch(spark: SparkSession, name: str, kept: bool = False) -> str:
    """A fresh path in the innermost scope's folder, or outside it if kept."""
    scopes = _SCOPES.get()
    scopes = scopes[:-1] if kept else scopes
    return f"{scopes[-1] if scopes else shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, kept: bool = False) -> tuple[DataFrame, str]:
    """Write df to a fresh table in the shared folder and read it back.

    The table cuts the lineage and survives lost executors. Returns the table
    and its path, for drop(). One that is kept outlives the innermost scope().
    """
    spark = df.sparkSession
    path = scratch(spark, name, kept)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that store() wrote and no later plan reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def numbered(rows: DataFrame, *order, name: str = "place") -> DataFrame:
    """rows with their place, from 1, in an order over all of them.

    Rows are sorted in ranges and stored with their number inside the range; the
    counts of the ranges, one row each, then say where a range begins. No task
    sees all rows.
    """
    inside = F.monotonically_increasing_id()  # the range above 33 bits, the number in it below
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", inside.alias("_at"))
    ranged, _ = store(ranged, "ranged")
    part, at = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    ranged = ranged.select("*", part, (at + 1).alias(name)).drop("_at")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(starts), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (u, v).

    component is the smallest node reachable. Alternating large-star and
    small-star contraction (Kiveris et al. 2014), written as joins against
    per-node minima, so no task holds a node's whole neighbour list and Spark
    can split the join of a hot node. Each round is written to the shared
    folder, and rounds go on until one changes nothing, a number that grows with
    the logarithm of the nodes squared. Nulls and loops are dropped; no edges give
    no rows.
    """
    spark = edges.sparkSession
    ends = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now, path = store(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, large_path = store(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, after_path = store(small.union(least.select("u", "m")).distinct(), "edges")
        drop(spark, large_path)
        drop(spark, path)
        now, path, before, state = after, after_path, state, _state(after)
        if before == state:
            break
    # every node now points at the root of its star
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
