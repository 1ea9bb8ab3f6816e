"""Loose objects near the surface."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import geometry as G
from .dims import small
from .rock import available_voxels


def search(candidates: DataFrame, text: str, families: list[str]) -> DataFrame:
    """Candidates (key, display, families) whose key, display name or family has
    the text, white space folded, and that belong to any of families; an empty
    text or list takes all."""
    folded = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    wish = " ".join(text.lower().split())
    has = F.lit(True) if not wish else folded(F.col("key")).contains(wish) | folded(F.col("display")).contains(wish) | F.exists("families", lambda f: folded(f).contains(wish))
    kept = candidates.where(has)
    return kept.where(F.arrays_overlap("families", F.array(*map(F.lit, families)))) if families else kept


def object_catalog(registry: DataFrame) -> DataFrame:
    """Candidates by qualified key: namespace, resource_key, families, block_ids.
    A block id belongs to one candidate, as its code has one identity."""
    named = registry.withColumn("o", C.object_identity(F.col("code"))).where("o IS NOT NULL").select("block_id", "o.*")
    qualified = F.when(F.col("namespace") == "", F.col("key")).otherwise(F.concat("namespace", F.lit(":"), "key"))
    return named.groupBy(qualified.alias("object_key")).agg(
        F.min("namespace").alias("namespace"), F.min("key").alias("resource_key"),
        F.array_sort(F.collect_set("family")).alias("families"), F.array_sort(F.collect_set("block_id")).alias("block_ids"))


def candidate_heights(heights: DataFrame, size_y: int) -> DataFrame:
    """(x, z, y) for y in [terrain - 2, terrain + 4) and [rain, rain + 4), clipped."""
    at = lambda c, a, b: F.sequence(F.col(c) + a, F.col(c) + b)
    ys = F.array_distinct(F.concat(at("terrain_y", -2, 3), at("rain_y", 0, 3)))
    return heights.select("x", "z", F.explode(ys).alias("y")).where(F.col("y").between(0, size_y - 1))


def object_observations(heights: DataFrame, voxels: DataFrame, catalog: DataFrame, coverage: DataFrame, size_y: int) -> DataFrame:
    """Wanted voxels near the surface in available chunks: object_key, x, y, z, block_id."""
    wanted = catalog.select("object_key", F.explode("block_ids").alias("block_id"))
    hits = available_voxels(voxels, coverage).join(small(wanted), "block_id")
    return hits.join(candidate_heights(heights, size_y), ["x", "z", "y"]).select("object_key", "x", "y", "z", "block_id")


def column_states(heights: DataFrame, observations: DataFrame, coverage: DataFrame, size_y: int) -> DataFrame:
    """Per state the columns: OBSERVED with a hit, else UNAVAILABLE if a candidate
    chunk is missing or failed, else NOT_OBSERVED."""
    keyed = candidate_heights(heights, size_y).withColumns({f"c{c}": G.to_chunk(F.col(c)) for c in "xyz"})
    gaps = keyed.select("x", "z", "cx", "cy", "cz").distinct().join(coverage, ["cx", "cy", "cz"], "left")
    gaps = gaps.groupBy("x", "z").agg(F.max(F.coalesce(F.col("status") != "AVAILABLE", F.lit(True))).alias("gap"))
    hits = observations.select("x", "z").distinct().withColumn("hit", F.lit(True))
    state = F.when(F.col("hit"), "OBSERVED").when(F.col("gap"), "UNAVAILABLE").otherwise("NOT_OBSERVED")
    return gaps.join(hits, ["x", "z"], "left").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("columns"))


def observed_objects(observations: DataFrame, catalog: DataFrame) -> DataFrame:
    """Observed candidates with display name, family labels and count."""
    counts = observations.groupBy("object_key").agg(F.count(F.lit(1)).alias("found"))
    named = catalog.join(counts, "object_key")
    return named.select("object_key", C.object_display(F.col("resource_key"), F.col("namespace")).alias("display"), C.family_labels(F.col("families")).alias("labels"), "found")
