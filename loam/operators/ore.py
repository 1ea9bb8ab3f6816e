"""Ore maps: which resource lies under which column, from voxels or an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import geometry as G
from .dims import is_small, small


def membership(registry: DataFrame, requests: DataFrame) -> DataFrame:
    """(resource, block_id) of every pair that matches; codes are matched by text,
    against the few different resources that requests name."""
    specs = requests.select("resource", "mode").distinct()
    return registry.join(small(specs), C.match_block(F.col("code"), F.col("resource"), F.col("mode"))).select("resource", "block_id").distinct()


def chunk_table(voxels: DataFrame) -> DataFrame:
    """Voxels as chunks: cx, cy, cz, palette, cells(x, y, z, block_id)."""
    keys = [G.to_chunk(F.col(c)).alias(f"c{c}") for c in "xyz"]
    return voxels.groupBy(*keys).agg(F.array_sort(F.collect_set("block_id")).alias("palette"), F.collect_list(F.struct("x", "y", "z", "block_id")).alias("cells"))


def lookup_chunks(chunks: DataFrame, positions: DataFrame) -> DataFrame:
    """Chunks at exact positions (cx, cy, cz)."""
    return chunks.join(positions.select("cx", "cy", "cz").distinct(), ["cx", "cy", "cz"], "left_semi")


def with_wanted(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """chunks (cx, cy, cz, palette, ...) with the flag has: whether the palette holds
    a wanted block_id. A few ids travel as one row, many are joined."""
    ids = wanted.select("block_id").distinct()
    if is_small(ids):
        one = F.broadcast(ids.agg(F.collect_set("block_id").alias("_ids")))
        return chunks.join(one).withColumn("has", F.arrays_overlap("palette", "_ids")).drop("_ids")
    held = chunks.select("cx", "cy", "cz", F.explode("palette").alias("block_id")).join(ids, "block_id", "left_semi")
    return chunks.join(held.select("cx", "cy", "cz").distinct().withColumn("has", F.lit(True)), ["cx", "cy", "cz"], "left").withColumn("has", F.coalesce("has", F.lit(False)))


def selective_chunks(chunks: DataFrame, positions: DataFrame, wanted: DataFrame) -> DataFrame:
    """lookup_chunks whose palette holds a wanted block_id."""
    return with_wanted(lookup_chunks(chunks, positions), wanted).where("has").drop("has")


def chunk_visits(positions: DataFrame, chunks: DataFrame, coverage: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per requested position: DECODED, PALETTE_REJECTED, FAILED, MISSING."""
    keys = ["cx", "cy", "cz"]
    asked = positions.select(*keys).distinct().join(coverage.select(*keys, "status"), keys, "left")
    asked = with_wanted(asked.join(chunks.select(*keys, "palette"), keys, "left"), wanted)
    visit = (
        F.when(F.col("status") == "FAILED", "FAILED").when(F.col("palette").isNull() | F.coalesce(F.col("status") == "MISSING", F.lit(True)), "MISSING")
        .when(F.col("has"), "DECODED").otherwise("PALETTE_REJECTED")
    )
    return asked.select(*keys, visit.alias("visit"))


def voxels_of(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.explode("cells").alias("c")).select("c.x", "c.y", "c.z", "c.block_id")


def _in_area():
    inside = G.in_circle(F.col("x"), F.col("z"), F.col("cx"), F.col("cz"), F.col("radius"))
    return inside & G.in_y_range(F.col("y"), F.col("y_min"), F.col("y_max"))


def ore_columns(voxels: DataFrame, registry: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request, resource and column: blocks, min_y, max_y.

    A request meets the voxels of the mapchunks it touches that have a block it
    asks for, so many requests far apart don't multiply. The voxels are shuffled
    once, after partial aggregation, where the requests are few.
    """
    areas = G.plan_mapchunks(requests).select("request_id", "resource", "cx", "cz", "radius", "y_min", "y_max", "mx", "mz")
    wanted = areas.join(small(membership(registry, requests)), "resource")
    keyed = voxels.select("x", "y", "z", "block_id", G.to_chunk(F.col("x")).alias("mx"), G.to_chunk(F.col("z")).alias("mz"))
    hits = keyed.join(small(wanted), ["mx", "mz", "block_id"]).where(_in_area())
    return hits.groupBy("request_id", "resource", "x", "z").agg(F.count(F.lit(1)).alias("blocks"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def ore_totals(columns: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request and resource: blocks, hit columns, lowest and highest y; a
    resource without a hit has 0, 0, -1, -1."""
    sums = columns.groupBy("request_id", "resource").agg(
        F.sum("blocks").alias("blocks"), F.count(F.lit(1)).alias("hit_columns"), F.min("min_y").alias("min_y"), F.max("max_y").alias("max_y"))
    all_ = requests.select("request_id", "resource").join(sums, ["request_id", "resource"], "left")
    return all_.select("request_id", "resource", *[F.coalesce(c, F.lit(d)).alias(c) for c, d in (("blocks", 0), ("hit_columns", 0), ("min_y", -1), ("max_y", -1))])


def ore_map(chunks: DataFrame, registry: DataFrame, requests: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """ore_columns from chunks: only planned chunks with a wanted id in their
    palette are unfolded."""
    plan = G.plan_chunks(requests, *size).select(F.col("mx").alias("cx"), F.col("my").alias("cy"), F.col("mz").alias("cz"))
    return ore_columns(voxels_of(selective_chunks(chunks, plan, membership(registry, requests))), registry, requests)


def y_masks(voxels: DataFrame) -> DataFrame:
    """Occurrences: cx, cy, cz, block_id, lx, lz, y_mask with bit y set. Grouped by the
    column itself, so voxels that are dealt out by it stay where they are."""
    bit = F.expr("shiftleft(1L, int(pmod(y, 32)))")
    per = voxels.groupBy("x", "z", G.to_chunk(F.col("y")).alias("cy"), "block_id").agg(F.bit_or(bit).alias("y_mask"))
    chunk, local = ({f"{p}{c}": f(F.col(c)).alias(f"{p}{c}") for c in "xz"} for p, f in (("c", G.to_chunk), ("l", G.local)))
    return per.select(chunk["cx"], "cy", chunk["cz"], "block_id", local["lx"], local["lz"], "y_mask")


def voxels_of_masks(occurrences: DataFrame) -> DataFrame:
    ys = F.expr("filter(sequence(0, 31), b -> (shiftrightunsigned(y_mask, b) & 1) = 1)")
    rows = occurrences.select("*", F.explode(ys).alias("ly"))
    return rows.select((F.col("cx") * 32 + F.col("lx")).alias("x"), (F.col("cy") * 32 + F.col("ly")).alias("y"), (F.col("cz") * 32 + F.col("lz")).alias("z"), "block_id")


def ore_map_indexed(occurrences: DataFrame, coverage: DataFrame, registry: DataFrame, requests: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """ore_columns from the index, for the requests whose planned chunks are all
    in coverage and none FAILED; ORE_CODE requests only."""
    plan = G.plan_chunks(requests, *size).select("request_id", F.col("mx").alias("cx"), F.col("my").alias("cy"), F.col("mz").alias("cz")).distinct()
    seen = plan.join(coverage, ["cx", "cy", "cz"], "left")
    served = seen.groupBy("request_id").agg(F.min(F.col("status").isNotNull() & (F.col("status") != "FAILED")).alias("ok")).where("ok").select("request_id")
    usable = requests.where("mode = 'ORE_CODE'").join(served, "request_id", "left_semi")
    return ore_columns(voxels_of_masks(occurrences), registry, usable)


def ore_block_catalog(registry: DataFrame) -> DataFrame:
    """Ore ids of at least 0 with the lexicographically smallest code."""
    return registry.where(C.is_ore(F.col("code")) & (F.col("block_id") >= 0)).groupBy("block_id").agg(F.min("code").alias("code"))


def ore_observation(voxels: DataFrame, registry: DataFrame, requests: DataFrame, coverage: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """Per request and resource OBSERVED, UNAVAILABLE or NOT_OBSERVED: any hit in
    an available chunk; else whether a planned chunk is missing or failed."""
    keys = ["cx", "cy", "cz"]
    open_ = coverage.where("status = 'AVAILABLE'").select(*keys)
    readable = voxels.withColumns({f"c{c}": G.to_chunk(F.col(c)) for c in "xyz"}).join(open_, keys, "left_semi").select("x", "y", "z", "block_id")
    hits = ore_columns(readable, registry, requests).select("request_id", "resource").distinct().withColumn("hit", F.lit(True))
    plan = G.plan_chunks(requests, *size).select("request_id", F.col("mx").alias("cx"), F.col("my").alias("cy"), F.col("mz").alias("cz")).distinct()
    gaps = plan.join(coverage, keys, "left").groupBy("request_id").agg(F.max(F.coalesce(F.col("status") != "AVAILABLE", F.lit(True))).alias("gap"))
    rows = requests.select("request_id", "resource").join(hits, ["request_id", "resource"], "left").join(gaps, "request_id", "left")
    return rows.select("request_id", "resource", F.when(F.col("hit"), "OBSERVED").when(F.coalesce("gap", F.lit(False)), "UNAVAILABLE").otherwise("NOT_OBSERVED").alias("observation"))


def ore_alpha(blocks):
    """Opacity of a column's cell: 85 to 195 by the logarithm of its blocks."""
    return F.floor(85 + 110 * F.least(F.lit(1.0), F.log10(blocks + 1.0)) + 0.5).cast("int")
