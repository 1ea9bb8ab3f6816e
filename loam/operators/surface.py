"""Surface of each column: fast by heights, or by a scan of the whole height."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import geometry as G
from .dims import large, small
from .graph import store
from .rock import available_voxels


#: A column by its chunk column first, so that tables in buckets of that stay where they are.
AT = ["cx", "cz", "x", "z"]


def with_codes(voxels: DataFrame, registry: DataFrame) -> DataFrame:
    """Voxels with their code; an unregistered id is unknown:<id>."""
    joined = voxels.join(small(registry.select("block_id", "code")), "block_id", "left")
    return joined.withColumn("registered", F.col("code").isNotNull()).withColumn("code", F.coalesce("code", F.concat(F.lit("unknown:"), F.col("block_id").cast("string"))))


def classified(voxels: DataFrame, registry: DataFrame, liquids: DataFrame) -> DataFrame:
    """Voxels with code, liquid_id (0 where none), class and class_code."""
    keys = AT if {"cx", "cz"} <= set(voxels.columns) else ["x", "z"]
    known = (G.with_chunks(liquids) if keys == AT else liquids).select(*keys, "y", "liquid_id")
    joined = with_codes(voxels, registry).join(large(known), [*keys, "y"], "left").withColumn("liquid_id", F.coalesce("liquid_id", F.lit(0)))
    liquid = small(registry.select(F.col("block_id").alias("liquid_id"), F.col("code").alias("liquid_code")))
    joined = joined.join(liquid, "liquid_id", "left")
    joined = joined.withColumn("class", C.surface_class(F.col("block_id"), F.when(F.col("registered"), F.col("code")), F.col("liquid_id"), F.col("liquid_code")))
    return joined.withColumn("class_code", C.surface_code(F.col("class"))).drop("liquid_code")


def _ground(rows: DataFrame):
    """A block that can be a surface: no air, and no foliage unless under water."""
    water = F.col("class") == "WATER"
    return ~C.is_air(F.col("block_id"), F.col("code")) & (water | ~C.is_foliage(F.col("block_id"), F.col("code"))) | water & (F.col("liquid_id") != 0)


def surface_top(voxels: DataFrame, registry: DataFrame, liquids: DataFrame) -> DataFrame:
    """Best surface of each column: x, z, y, block_id, liquid_id, class of the
    highest block that can be one, ties by block. voxels has a row for each place.

    Solid blocks need no liquid to count, so only air and foliage meet the liquids
    before the heights are compared, and the winners after it. y and block travel
    as one long, which a hash aggregate takes.
    """
    # codes are judged once for each registered block, not for each voxel
    kinds = registry.select("block_id", (C.is_air(F.col("block_id"), F.col("code")) | C.is_foliage(F.col("block_id"), F.col("code"))).alias("_soft"))
    coded = G.with_chunks(voxels).select(*AT, "y", "block_id").join(small(kinds), "block_id", "left")
    soft = F.coalesce("_soft", F.col("block_id") == 0)
    packed = (F.shiftleft(F.col("y").cast("long"), 32) + F.col("block_id")).alias("packed")
    known = G.with_chunks(liquids)
    if "cx" not in voxels.columns:  # nothing lies in buckets: one shuffle of both sides together
        under = coded.where(soft).select("x", "y", "z", "block_id").join(large(liquids.select("x", "y", "z")), ["x", "y", "z"], "left_semi")
        wet = classified(under, registry, liquids)
        rows = coded.where(~soft).select("x", "z", packed).unionByName(wet.where(_ground(wet)).select("x", "z", packed))
        top = rows.groupBy("x", "z").agg(F.max("packed").alias("packed"))
        best = top.select("x", F.shiftright("packed", 32).cast("int").alias("y"), "z", F.col("packed").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("block_id"))
        return classified(best, registry, liquids).select("x", "z", "y", "block_id", "liquid_id", "class")
    under = coded.where(soft).select(*AT, "y", "block_id").join(large(known.select(*AT, "y")), [*AT, "y"], "left_semi")
    wet = classified(under, registry, known)
    # each side is reduced for itself, and a column's two winners meet where they lie
    solid = coded.where(~soft).select(*AT, packed).groupBy(*AT).agg(F.max("packed").alias("_solid"))
    soaked = wet.where(_ground(wet)).select(*AT, packed).groupBy(*AT).agg(F.max("packed").alias("_soaked"))
    top = solid.join(large(soaked), AT, "full").select(*AT, F.greatest("_solid", "_soaked").alias("packed"))
    best = top.select(*AT, F.shiftright("packed", 32).cast("int").alias("y"), F.col("packed").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("block_id"))
    return classified(best, registry, known).select("x", "z", "y", "block_id", "liquid_id", "class")


def height_voxels(heights: DataFrame, voxels: DataFrame) -> DataFrame:
    """The one voxel of each column at its rain height; null where there is none."""
    return heights.join(voxels, (heights["x"] == voxels["x"]) & (heights["z"] == voxels["z"]) & (heights["rain_y"] == voxels["y"]), "left").select(heights["x"], heights["z"], "rain_y", "block_id")


def resolve_surface(columns: DataFrame | None, heights: DataFrame, voxels: DataFrame, registry: DataFrame, liquids: DataFrame, coverage: DataFrame, no_liquids: DataFrame, size_y: int) -> DataFrame:
    """x, z, path, y, block_id, liquid_id, class of the columns (x, z); without them of
    all columns that have a voxel, available or not.

    FAST takes the voxel at the rain height. A mapchunk falls back as a whole,
    to the best voxel of the whole height, when one of its columns has no height
    or one out of range, its chunk is not available, its liquids are missing
    (mapchunks mx, mz of no_liquids), or the block there is air or foliage and
    no water. Columns without a surface have no row.
    """
    if "cx" in voxels.columns:
        return _resolved_in_buckets(voxels.select(*AT) if columns is None else columns, heights, voxels, registry, liquids, coverage, no_liquids, size_y)
    chunk = ["cx", "cz"]
    dry = small(no_liquids.select(F.col("mx").alias("cx"), F.col("mz").alias("cz")).distinct())
    known = G.with_chunks(liquids).join(dry, chunk, "left_anti")
    if columns is None:  # voxels ask for their columns themselves
        seen, asked = _asking(voxels, coverage), []
    else:
        seen, asked = available_voxels(voxels, coverage), [G.with_chunks(columns.select("x", "z").distinct()).withColumn("asked", F.lit(1))]
    rain = G.with_chunks(heights).select(*AT, F.col("rain_y").alias("y"), F.lit(1).alias("rain"))
    rows = judged(seen, known, registry, rain, *asked)
    packed = lambda v: F.shiftleft(F.col("y").cast("long"), 32) + F.col(v)
    best = lambda v: F.max(F.when(F.col("ground"), packed(v)))
    at_rain = lambda v: F.max(F.when(F.col("rain") == 1, v))
    per = rows.groupBy(*AT).agg(
        F.max("asked").alias("asked"), best("block_id").alias("_block"), best("liquid_id").alias("_liquid"), at_rain(F.col("y")).alias("rain_y"),
        at_rain(F.col("block_id")).alias("block_id"), at_rain(F.col("liquid_id")).alias("liquid_id"), at_rain(F.col("ground")).alias("ground"))
    per = per.where("asked = 1").join(dry.withColumn("dry", F.lit(True)), chunk, "left")
    bad = F.col("rain_y").isNull() | ~G.in_world(F.col("rain_y"), size_y) | F.col("dry").isNotNull() | ~F.coalesce("ground", F.lit(False))
    per = per.withColumn("fallback", F.max(bad).over(Window.partitionBy(*chunk))).where("NOT fallback OR _block IS NOT NULL")
    low = lambda v: F.col(v).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    pick = lambda slow, fast: F.when(F.col("fallback"), slow).otherwise(F.col(fast))
    found = per.select(
        "x", "z", F.when(F.col("fallback"), "FALLBACK").otherwise("FAST").alias("path"), pick(F.shiftright("_block", 32).cast("int"), "rain_y").alias("y"),
        pick(low("_block"), "block_id").alias("block_id"), pick(low("_liquid"), "liquid_id").alias("liquid_id"))
    return _with_class(found, registry).select("x", "z", "path", "y", "block_id", "liquid_id", "class")


def _asking(voxels: DataFrame, coverage: DataFrame) -> DataFrame:
    """All voxels with asked, 1, and their block only where their chunk is available."""
    open_ = coverage.where("status = 'AVAILABLE'").groupBy("cx", "cz").agg(F.collect_set("cy").alias("_open"))
    rows = G.with_chunks(voxels).join(small(open_), ["cx", "cz"], "left")
    seen = F.when(F.array_contains("_open", G.to_chunk(F.col("y"))), F.col("block_id"))
    return rows.select(*AT, "y", seen.alias("block_id"), F.lit(1).alias("asked"))


def _with_class(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """rows (block_id, liquid_id, ..) with class and ground. Codes are judged once for
    each registered block and liquid, not for each row."""
    code = F.coalesce("code", F.concat(F.lit("unknown:"), F.col("block_id").cast("string")))
    none = F.lit(None).cast("string")
    kinds = registry.select(
        "block_id", C.surface_class(F.col("block_id"), F.col("code"), F.lit(0), none).alias("_kind"),
        C.is_air(F.col("block_id"), code).alias("_air"), C.is_foliage(F.col("block_id"), code).alias("_foliage"))
    wet = C.surface_class(F.lit(0), none, F.col("block_id"), F.col("code")) == "WATER"
    liquid = registry.where(wet).select(F.col("block_id").alias("liquid_id"), F.lit("WATER").alias("_wet"))
    joined = rows.join(small(kinds), "block_id", "left").join(small(liquid), "liquid_id", "left")
    joined = joined.withColumn("class", F.coalesce("_wet", "_kind", F.lit("UNKNOWN")))
    air, foliage, water = F.coalesce("_air", F.col("block_id") == 0), F.coalesce("_foliage", F.lit(False)), F.col("class") == "WATER"
    ground = ~air & (water | ~foliage) | water & (F.col("liquid_id") != 0)
    return joined.withColumn("ground", ground).drop("_kind", "_air", "_foliage", "_wet")


def judged(voxels: DataFrame, liquids: DataFrame, registry: DataFrame, *marks: DataFrame) -> DataFrame:
    """cx, cz, x, z, y, block_id, liquid_id (0 where none), class, ground of each voxel.

    Voxels, liquids and rows of marks (cx, cz, x, z, maybe y, and a number that stays a
    column of the result) are dealt out by their chunk column together, and met by an
    aggregate for each place: one shuffle and no sort. What is grouped by column or
    mapchunk after it stays where it is. Places of marks without a voxel have no block.
    Voxels may carry such a number themselves, as asked.
    """
    own = [c for c in voxels.columns if c == "asked"]
    numbers = own + [c for m in marks for c in m.columns if c not in (*AT, "y")]
    rows = [G.with_chunks(voxels).select(*AT, "y", "block_id", *own), G.with_chunks(liquids).select(*AT, "y", "liquid_id"), *marks]
    met = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows).repartition("cx", "cz")
    per = met.groupBy(*AT, "y").agg(*[F.max(c).alias(c) for c in ("block_id", "liquid_id", *numbers)])
    per = per.where(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in ("block_id", *numbers)]))
    return _with_class(per.withColumn("liquid_id", F.coalesce("liquid_id", F.lit(0))), registry).withColumn("ground", F.col("block_id").isNotNull() & F.col("ground"))


def _resolved_in_buckets(columns, heights, voxels, registry, liquids, coverage, no_liquids, size_y):
    """resolve_surface() over tables in buckets: by joins, which meet where the buckets lie."""
    chunk = ["cx", "cz"]
    seen = available_voxels(voxels, coverage).select(*AT, "y", "block_id")
    dry = small(no_liquids.select(F.col("mx").alias("cx"), F.col("mz").alias("cz")).distinct())
    wanted = G.with_chunks(columns).select(*AT).distinct()
    asked = wanted.join(large(G.with_chunks(heights).select(*AT, "rain_y")), AT, "left")
    # one voxel of each column is looked up and classified
    at = classified(asked.where("rain_y IS NOT NULL").withColumnRenamed("rain_y", "y").join(large(seen), [*AT, "y"]), registry, G.with_chunks(liquids))
    at = at.select(*AT, "block_id", "liquid_id", "class", _ground(at).alias("ground"))
    flags = asked.join(large(at), AT, "left").join(dry.withColumn("dry", F.lit(True)), chunk, "left")
    bad = F.col("rain_y").isNull() | ~G.in_world(F.col("rain_y"), size_y) | F.col("dry").isNotNull() | ~F.coalesce("ground", F.lit(False))
    flags, _ = store(flags.withColumn("bad", bad), "flags")
    chunks = flags.groupBy(*chunk).agg(F.max("bad").alias("fallback"))
    fast = flags.join(small(chunks.where("NOT fallback")), chunk, "left_semi").select("x", "z", F.lit("FAST").alias("path"), F.col("rain_y").alias("y"), "block_id", "liquid_id", "class")
    # whole columns only where a mapchunk falls back; one whose liquids are missing
    # is classified without them
    slow = seen.join(small(chunks.where("fallback").select(*chunk)), chunk, "left_semi").join(large(wanted), AT, "left_semi")
    known = G.with_chunks(liquids).join(dry, chunk, "left_anti")
    return fast.unionByName(surface_top(slow, registry, known).withColumn("path", F.lit("FALLBACK")))


def surface_diagnostics(columns: DataFrame, surface: DataFrame, registry: DataFrame, coverage: DataFrame, no_liquids: DataFrame) -> DataFrame:
    """One row over the asked columns (x, z) and their resolved surface: chunks
    scanned (available ones of the columns' mapchunks), columns scanned, empty and
    without liquids, water columns, surface blocks of class UNKNOWN, their distinct
    codes and all distinct codes."""
    keys = {"mx": G.to_chunk(F.col("x")), "mz": G.to_chunk(F.col("z"))}
    asked = columns.select("x", "z").distinct().withColumns(keys)
    open_ = coverage.where("status = 'AVAILABLE'").select(F.col("cx").alias("mx"), "cy", F.col("cz").alias("mz"))
    chunks = open_.join(asked.select("mx", "mz").distinct(), ["mx", "mz"], "left_semi").agg(F.count(F.lit(1)).alias("chunks_scanned"))
    rows = asked.join(with_codes(surface, registry).select("x", "z", "class", "code"), ["x", "z"], "left")
    rows = rows.join(small(no_liquids.select("mx", "mz", F.lit(True).alias("dry")).distinct()), ["mx", "mz"], "left")
    unknown = F.col("class") == "UNKNOWN"
    counts = rows.agg(
        F.count(F.lit(1)).alias("columns_scanned"), F.count_if(F.col("class").isNull()).alias("empty_columns"), F.count("dry").alias("liquid_unavailable_columns"),
        F.count_if(F.col("class") == "WATER").alias("water_columns"), F.count_if(unknown).alias("unknown_blocks"),
        F.countDistinct(F.when(unknown, F.col("code"))).alias("unknown_codes"), F.countDistinct("code").alias("codes"))
    return counts.join(F.broadcast(chunks))  # one row each


def unknown_codes(surface: DataFrame, registry: DataFrame, limit: int) -> DataFrame:
    """The most frequent codes of surface blocks of class UNKNOWN, ties by code."""
    counts = with_codes(surface.where("class = 'UNKNOWN'"), registry).groupBy("code").agg(F.count(F.lit(1)).alias("blocks"))
    return counts.orderBy(F.desc("blocks"), "code").limit(limit)


def fallback_diagnostics(classified_voxels: DataFrame, no_liquids: DataFrame) -> DataFrame:
    """Per mapchunk: columns considered, resolved, and without liquids, each
    column once however many vertical chunks it has. Of classified() or judged() voxels;
    the latter lie by mapchunk already."""
    ground = F.col("ground") if "ground" in classified_voxels.columns else _ground(classified_voxels)
    per = G.with_chunks(classified_voxels).groupBy(*AT).agg(F.max(ground).alias("resolved")).withColumnsRenamed({"cx": "mx", "cz": "mz"})
    per = per.join(small(no_liquids.select("mx", "mz", F.lit(1).alias("dry"))), ["mx", "mz"], "left")
    return per.groupBy("mx", "mz").agg(F.count(F.lit(1)).alias("considered"), F.count_if("resolved").alias("resolved"), F.count("dry").alias("liquid_missing"))


def soil_map(surface: DataFrame, registry: DataFrame) -> DataFrame:
    """Fertility of each resolved column that is no water and no snow."""
    dim = registry.withColumn("f", C.soil_fertility(F.col("code"))).where("f IS NOT NULL").select("block_id", "f.tier", "f.percent")
    return surface.where("class NOT IN ('WATER', 'SNOW')").join(small(dim), "block_id").select("x", "z", "tier", "percent")


def probe(points: DataFrame, surface: DataFrame, rock_columns: DataFrame) -> DataFrame:
    """Surface and rock at requested (x, z); unknown places keep nulls."""
    s = surface.select("x", "z", F.col("y").alias("surface_y"), F.col("block_id").alias("surface_block"), "class")
    r = rock_columns.select("x", "z", F.col("state").alias("rock_state"), "rock_code")
    return points.join(s, ["x", "z"], "left").join(r, ["x", "z"], "left")
