"""Topmost rock of each column, with honest states for missing chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import geometry as G
from .dims import large, small


def rocks(registry: DataFrame) -> DataFrame:
    return registry.withColumn("rock_code", C.rock_code(F.col("code"))).where("rock_code IS NOT NULL").select("block_id", "rock_code")


def available_voxels(voxels: DataFrame, coverage: DataFrame) -> DataFrame:
    """Voxels of AVAILABLE chunks, with cx, cy, cz. They meet one row of each chunk column,
    with its available chunks, so the voxels stay where they are while those rows are few."""
    keyed = G.with_chunks(voxels).withColumn("cy", G.to_chunk(F.col("y")))
    open_ = coverage.where("status = 'AVAILABLE'").groupBy("cx", "cz").agg(F.collect_set("cy").alias("_open"))
    return keyed.join(small(open_), ["cx", "cz"]).where(F.array_contains("_open", F.col("cy"))).drop("_open")


def upper_rock(voxels: DataFrame, registry: DataFrame, coverage: DataFrame, cells: DataFrame, y_min: int, y_max: int) -> DataFrame:
    """For each cell (x, z): state, rock_id, rock_code, y.

    OBSERVED needs a rock in the range and every chunk above it available; gaps
    below don't matter. Without a rock the cell is NO_ROCK if the whole range is
    available, else UNAVAILABLE. coverage has one row for each chunk, a missing
    row counts as missing. Voxels and cells that carry their chunk column (cx, cz) are
    keyed by it first, so tables in buckets of it (sources/bucketed.py) are not shuffled.
    """
    low, high = y_min // G.CHUNK, y_max // G.CHUNK
    at = ["cx", "cz", "x", "z"] if {"cx", "cz"} <= set(voxels.columns) & set(cells.columns) else ["x", "z"]
    columns = G.with_chunks(cells.select(*at).distinct())
    needed = columns.select("cx", "cz").distinct().withColumn("cy", F.explode(F.sequence(F.lit(low), F.lit(high))))
    gaps = needed.join(coverage, ["cx", "cy", "cz"], "left")
    gaps = gaps.groupBy("cx", "cz").agg(F.max(F.when(F.coalesce(F.col("status") != "AVAILABLE", F.lit(True)), F.col("cy"))).alias("gap"))
    dim = small(rocks(registry))
    hits = available_voxels(voxels.where(F.col("y").between(y_min, y_max)).join(dim, "block_id", "left_semi"), coverage)
    # y above block_id in one long: a hash aggregate, where a struct would need sorting
    packed = F.max(F.shiftleft(F.col("y").cast("long"), 32) + F.col("block_id")).alias("packed")
    top = hits.groupBy(*at).agg(packed).select(*at, F.shiftright("packed", 32).cast("int").alias("y"), F.col("packed").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("block_id"))
    top = top.join(dim, "block_id").select(*at, F.struct("y", "block_id", "rock_code").alias("top"))
    rows = columns.join(large(top), at, "left").join(gaps, ["cx", "cz"], "left")
    clear = F.col("gap").isNull() | (F.floor((F.col("top.y") + 1) / G.CHUNK) > F.col("gap"))
    state = F.when(F.col("top").isNotNull() & clear, "OBSERVED").when(F.col("top").isNull() & F.col("gap").isNull(), "NO_ROCK").otherwise("UNAVAILABLE")
    seen = rows.withColumn("state", state)
    pick = lambda c: F.when(F.col("state") == "OBSERVED", F.col(f"top.{c}"))
    return seen.select("x", "z", "state", pick("block_id").alias("rock_id"), pick("rock_code").alias("rock_code"), pick("y").alias("y"))


def rock_legend(columns: DataFrame) -> DataFrame:
    """Per rock: columns, percent of the observed, place by count then code."""
    counts = columns.where("state = 'OBSERVED'").groupBy("rock_code").agg(F.count(F.lit(1)).alias("columns"))
    all_ = Window.partitionBy(F.lit(1))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("columns"), "rock_code")
    return counts.select("rock_code", "columns", (F.col("columns") * 100.0 / F.sum("columns").over(all_)).alias("percent"), F.row_number().over(order).alias("place"))


def state_totals(columns: DataFrame) -> DataFrame:
    return columns.groupBy("state").agg(F.count(F.lit(1)).alias("columns"))
