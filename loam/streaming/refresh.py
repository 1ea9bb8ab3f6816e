"""Incremental refresh of derived tables as new chunk rows arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import ore
from ..operators.dims import small
from ..operators.graph import drop, scope, store
from ..sources import decode, published
from ..sources.tables import COVERAGE, exists, publish, write_catalog, write_resource_index

KEYS = ["cx", "cy", "cz"]


def latest(rows: DataFrame, keys: list[str], order) -> DataFrame:
    """The row of each key with the highest order."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest]).select(rows.columns)


def upsert(batch: DataFrame, path: str, order: str = "event_id") -> None:
    """Merge a batch into the table at path: of each key the highest order wins.
    Only the regions the batch touches are rewritten, and running it again
    changes nothing."""
    spark = batch.sparkSession
    region = {"rx": G.to_region(F.col("cx")), "rz": G.to_region(F.col("cz"))}
    new = latest(batch, KEYS, order).withColumns(region)
    if exists(spark, path):
        old = spark.read.parquet(path).select(new.columns)
        touched = new.select("rx", "rz").distinct()
        new = latest(new.unionByName(old.join(touched, ["rx", "rz"], "left_semi")), KEYS, order)
        kept, where = store(new, "upsert")  # the table is read and replaced
        publish(kept, path, ["rx", "rz"])
        drop(spark, where)
    else:
        publish(new, path, ["rx", "rz"])


def stream_status(arrivals: DataFrame, path: str, checkpoint: str):
    """Arriving chunk rows (event_id, cx, cy, cz, status) into the table at path.
    Returns the query, which stops when all that is there has been read."""
    return _each_batch(arrivals, lambda batch, _: upsert(batch.drop("ts"), path), checkpoint)


def index_chunks(batch: DataFrame, registry: DataFrame, size: tuple[int, int, int], path: str, number: int | None = None) -> None:
    """Decode arriving raw chunks (event_id, position, data) into the resource index
    at path: occurrences of ore blocks inside the world, and coverage AVAILABLE or,
    where a payload can't be read, FAILED.

    Of a position the row with the highest event_id counts, ties by payload, also
    against what is stored, so batches may come in any order; what was stored of a
    chunk goes with the same publication that brings the new. Keys that can't be
    read or lie in another dimension are left out. A batch whose number has been
    published changes nothing.
    """
    spark = batch.sparkSession
    if number is not None and published.noted(spark, path, number):
        return
    with scope(spark):
        newest = latest(batch.select("event_id", "position", "data"), ["position"], F.struct("event_id", "data"))
        at = newest.withColumn("p", G.decode_position(F.col("position"))).where("p.x IS NOT NULL AND p.dim = 0")
        keyed = at.select(F.col("p.x").alias("cx"), F.col("p.y").alias("cy"), F.col("p.z").alias("cz"), "event_id", "data")
        touched = keyed.select(G.to_region(F.col("cx")).alias("rx"), G.to_region(F.col("cz")).alias("rz"))
        coverage = keyed.select(*KEYS, F.lit("").alias("status"), "event_id")
        seen = published.read(spark, path, COVERAGE, coverage.schema, touched).select(*KEYS, F.col("event_id").alias("_seen"))
        fresh = keyed.join(seen, KEYS, "left").where("_seen IS NULL OR event_id > _seen").drop("_seen")
        wanted = ore.ore_block_catalog(registry).select("block_id")
        kept = F.expr("IF(has, data, NULL)").alias("data")
        decoded, _ = store(ore.with_wanted(decode.read_chunk(fresh), wanted).select(*KEYS, "event_id", "error", kept), "decoded")
        if decoded.isEmpty():
            return
        inside = [G.in_world(F.col(c), n) for c, n in zip("xyz", size)]
        voxels = decode.raw_voxels(decoded.where("data IS NOT NULL")).where(inside[0] & inside[1] & inside[2]).join(small(wanted), "block_id", "left_semi")
        status = F.when(F.col("error").isNull(), "AVAILABLE").otherwise("FAILED")
        write_resource_index(ore.y_masks(voxels), decoded.select(*KEYS, status.alias("status"), "event_id"), path, number)


def stream_index(arrivals: DataFrame, registry: DataFrame, size: tuple[int, int, int], path: str, checkpoint: str):
    """index_chunks() of a stream of raw chunks, batch by batch. Returns the query,
    which stops when all that is there has been read."""
    return _each_batch(arrivals, lambda batch, number: index_chunks(batch, registry, size, path, number), checkpoint)


def _each_batch(rows: DataFrame, work, checkpoint: str):
    return rows.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def discover(batch: DataFrame, path: str) -> None:
    """Mapchunks (world, mx, mz) of a page of keys (position, world, complete) into
    the catalog at path, whose mark says whether the page is the last: only then
    may what is missing be called absent."""
    spark = batch.sparkSession
    p = G.decode_position(F.col("position"))
    seen = batch.where("position IS NOT NULL").withColumn("p", p).where("p.x IS NOT NULL AND p.dim = 0 AND p.y = 0")
    write_catalog(seen.select("world", F.col("p.x").alias("mx"), F.col("p.z").alias("mz")), path, ["world", "mx", "mz"])
    ended = batch.agg(F.coalesce(F.max("complete"), F.lit(False)).alias("complete"))
    store_mark, where = store(ended, "mark")
    store_mark.write.mode("overwrite").parquet(f"{path}/complete")
    drop(spark, where)


def stream_discovery(pages: DataFrame, path: str, checkpoint: str):
    """discover() of the pages of a save's stream. Returns the query, which goes on
    until it is stopped: processAllAvailable() returns when the cursor is at the
    end. A query that starts with the same checkpoint goes on from its cursor."""
    return pages.writeStream.foreachBatch(lambda batch, _: discover(batch, path)).option("checkpointLocation", checkpoint).start()
