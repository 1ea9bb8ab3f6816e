"""Chunk tables in buckets of their chunk column, so that what belongs together lies
together: joins of voxels with heights, liquids and coverage, and aggregates of
columns and mapchunks, read bucket by bucket without a shuffle.

    tables = {n: write(df, path + n, buckets) for n, df in ..}
    co_located(spark)
    rock.upper_rock(tables["voxels"], ..)

The tables are catalog tables of the session over Parquet files at a path.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions import geometry as G


def write(rows: DataFrame, path: str, buckets: int, name: str | None = None) -> DataFrame:
    """Store rows (x, z, .. or cx, cz, ..) in buckets of (cx, cz), sorted by them and
    by x, z, and read them back. All tables that are to meet need the same number of
    buckets; about as many as keep a bucket of the largest under a few hundred MB.
    Rows are dealt to one task a bucket first, so that a bucket is one file."""
    spark, name = rows.sparkSession, name or f"loam_{uuid.uuid4().hex}"
    keyed = G.with_chunks(rows) if "x" in rows.columns else rows
    order = [c for c in ("cx", "cz", "x", "z", "y", "cy") if c in keyed.columns]
    dealt = keyed.repartition(buckets, "cx", "cz")
    dealt.write.bucketBy(buckets, "cx", "cz").sortBy(*order).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def co_located(spark: SparkSession) -> None:
    """Let joins on (cx, cz) and more columns use the buckets: by default Spark wants
    all columns of a join among the keys that rows are dealt by. For the session."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
