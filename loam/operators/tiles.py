"""Tile tables: sampling grids, shading and pixels at several levels of detail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import colours as P
from ..functions import geometry as G
from .dims import large


def height_range(heights: DataFrame) -> DataFrame:
    """One row: lowest and highest height, 0 and 0 if there is none."""
    return heights.agg(F.coalesce(F.min("height"), F.lit(0)).alias("low"), F.coalesce(F.max("height"), F.lit(0)).alias("high"))


def neighbours4(heights: DataFrame, step: int) -> DataFrame:
    """heights (x, z, height) with west, east, north, south at a distance.

    Every height is dealt to the four columns that see it and to itself, so one
    shuffle on (x, z) replaces four joins.
    """
    at = [("west", step, 0), ("east", -step, 0), ("north", 0, step), ("south", 0, -step), ("height", 0, 0)]
    dealt = F.array(*[F.struct(F.lit(n).alias("role"), (F.col("x") + dx).alias("x"), (F.col("z") + dz).alias("z"), "height") for n, dx, dz in at])
    rows = heights.select("x", "z", "height").select(F.explode(dealt).alias("d")).select("d.*")
    wide = rows.groupBy("x", "z").agg(*[F.max(F.when(F.col("role") == n, F.col("height"))).alias(n) for n, _, _ in at])
    return wide.where("height IS NOT NULL")


def sample_grid(bounds: DataFrame, lod: int) -> DataFrame:
    """Pixels (px, pz) of tiles (tx, tz, x0, x1, z0, z1) and the column (x, z)
    each one samples: the middle of its blocks, clipped to the tile."""
    b = G.LODS[lod]
    axis = lambda lo, hi: F.sequence(F.lit(0), F.ceil((F.col(hi) - F.col(lo)) / b).cast("int") - 1)
    grid = bounds.withColumn("px", F.explode(axis("x0", "x1"))).withColumn("pz", F.explode(axis("z0", "z1")))
    pick = lambda lo, hi, p: F.least(F.col(lo) + F.col(p) * b + b // 2, F.col(hi) - 1).cast("int")
    return grid.select("tx", "tz", F.lit(lod).alias("lod"), "px", "pz", pick("x0", "x1", "px").alias("x"), pick("z0", "z1", "pz").alias("z"))


def tile_bounds(mapchunks: DataFrame, span: int, size_x: int, size_z: int) -> DataFrame:
    """Tiles of span mapchunks that hold any of (mx, mz), clipped to the world."""
    tiles = mapchunks.select(G.to_tile(F.col("mx"), span).alias("tx"), G.to_tile(F.col("mz"), span).alias("tz")).distinct()
    wide = span * G.CHUNK
    return tiles.select(
        "tx", "tz", F.greatest(F.col("tx") * wide, F.lit(0)).alias("x0"), F.least((F.col("tx") + 1) * wide, F.lit(size_x)).alias("x1"),
        F.greatest(F.col("tz") * wide, F.lit(0)).alias("z0"), F.least((F.col("tz") + 1) * wide, F.lit(size_z)).alias("z1"))


def stencil(pixels: DataFrame, heights: DataFrame) -> DataFrame:
    """pixels (.., lod, x, z) with height, west, east, north, south: of their own
    column and of four at the level's step, null where there is none.

    Each different column that pixels sample asks for its five heights, and only
    what is asked meets the heights. So a level has a quarter of the rows of the one
    below it, and the heights are shuffled once for all levels.
    """
    step = F.expr("shiftleft(1, lod)")
    at = [("height", 0, 0), ("west", -1, 0), ("east", 1, 0), ("north", 0, -1), ("south", 0, 1)]
    asks = F.array(*[F.struct(F.lit(n).alias("role"), (F.col("x") + dx * step).alias("ax"), (F.col("z") + dz * step).alias("az")) for n, dx, dz in at])
    asked = pixels.select("lod", "x", "z").distinct().select("lod", "x", "z", F.explode(asks).alias("a")).select("lod", "x", "z", "a.*")
    met = asked.join(large(heights.select(F.col("x").alias("ax"), F.col("z").alias("az"), F.col("height").alias("_h"))), ["ax", "az"])
    wide = met.groupBy("lod", "x", "z").agg(*[F.max(F.when(F.col("role") == n, F.col("_h"))).alias(n) for n, _, _ in at])
    return pixels.join(large(wide), ["lod", "x", "z"], "left")


def raster_size(radius, pixels_per_block):
    """Pixels on a side of a request's raster, 64 to 4096."""
    return F.least(F.greatest(radius.cast("long") * 2 * pixels_per_block + 1, F.lit(64)), F.lit(4096)).cast("int")


def request_axes(requests: DataFrame) -> DataFrame:
    """requests (.., cx, cz, radius, pixels_per_block) with raster, what is sampled
    (x0, z0, width) and its axis: for each pixel of a side the offset of the block
    it shows, floor(pixel / scale). At most 4,096 of them."""
    sized = requests.withColumns({"raster": raster_size(F.col("radius"), F.col("pixels_per_block")), "width": F.col("radius") * 2})
    scale = F.col("raster").cast("double") / F.col("width")
    return _with_axis(sized, lambda p: F.least(F.col("width") - 1, F.floor(p / scale)))


def rock_axes(requests: DataFrame, most: int = 4096) -> DataFrame:
    """As request_axes() for the raster of a rock map: a pixel for each block, most at
    most, and floor((pixel + 0.5) * width / raster)."""
    sized = requests.withColumn("width", F.col("radius") * 2 + 1).withColumn("raster", F.least(F.col("width"), F.lit(most)))
    return _with_axis(sized, lambda p: F.least(F.col("width") - 1, F.floor((p + 0.5) * F.col("width") / F.col("raster").cast("double"))))


def _with_axis(sized: DataFrame, offset) -> DataFrame:
    axis = F.transform(F.sequence(F.lit(0), F.col("raster") - 1), lambda p: F.struct(p.alias("pixel"), offset(p).cast("int").alias("offset")))
    corner = {f"{c}0": (F.floor(f"c{c}") - F.col("radius")).cast("int") for c in "xz"}
    return sized.where("radius > 0").withColumns({**corner, "axis": axis})


def raster_samples(columns: DataFrame, sized: DataFrame, key: str) -> DataFrame:
    """key, px, pz and the columns (x, z, ..) that the pixels of each request (key, x0,
    z0, width, axis) show.

    Sampling is inverted: a column in a request's square looks its pixels up in two
    axis tables, one for each side, and drops out where there is none. Pixels without
    a column make no row, and no grid of all pixels is made.
    """
    reach = lambda c: F.sequence(G.to_chunk(F.col(c)), G.to_chunk(F.col(c) + F.col("width") - 1))
    squares = sized.select(key, "x0", "z0", F.explode(reach("x0")).alias("_mx"), "width").select(key, "x0", "z0", "_mx", "width", F.explode(reach("z0")).alias("_mz"))
    met = columns.withColumns({"_mx": G.to_chunk(F.col("x")), "_mz": G.to_chunk(F.col("z"))}).join(squares, ["_mx", "_mz"])
    axis = sized.select(key, F.explode("axis").alias("a"))
    rows = met.withColumns({"_dx": F.col("x") - F.col("x0"), "_dz": F.col("z") - F.col("z0")})
    for side, pixel in (("_dx", "px"), ("_dz", "pz")):
        rows = rows.join(axis.select(key, F.col("a.offset").alias(side), F.col("a.pixel").alias(pixel)), [key, side])
    return rows.select(key, "px", "pz", *columns.columns)


def tile_pyramid(bounds: DataFrame, heights: DataFrame, surface: DataFrame, soil: DataFrame, lods=range(len(G.LODS)), style: str = "SIMPLE") -> DataFrame:
    """tx, tz, lod, px, pz, argb of every pixel whose column has a height or a
    surface: terrain shaded by the slope at the level's step, then the surface's
    colour, then the soil's over it. heights (x, z, height), surface (x, z,
    class), soil (x, z, tier). The height range is one row. All levels go through
    the same joins, each with the columns that its pixels sample and no others."""
    span = F.broadcast(height_range(heights))  # one row
    pixels = reduce(DataFrame.unionByName, [sample_grid(bounds, lod) for lod in lods])
    shaded = stencil(pixels, heights).withColumn("shade", F.coalesce(P.hillshade(*(F.col(c) for c in ("west", "east", "north", "south"))), F.lit(0.0)))
    rows = shaded.join(large(surface.select("x", "z", "class")), ["x", "z"], "left").join(large(soil.select("x", "z", "tier")), ["x", "z"], "left").join(span)
    ground = F.when(F.col("height").isNotNull(), P.terrain_argb(F.col("height"), F.col("low"), F.col("high"), F.col("shade"), style))
    top = F.coalesce(F.when(F.col("class").isNotNull(), P.surface_argb(F.col("class"), F.col("shade"))), ground)
    return rows.withColumn("argb", P.soil_blend(top, F.col("tier"))).where("argb IS NOT NULL").select("tx", "tz", "lod", "px", "pz", "argb")


def cover_pixels(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, px, pz, class from surface cells (keys, x, z, class, x0, z0, scale,
    raster): pixels from floor to ceil of a cell's scaled sides, clipped to the raster;
    of the cells that cover one the last, in the order of mapchunk z, mapchunk x, z, x."""
    lo = lambda c: F.greatest(F.floor((F.col(c) - F.col(f"{c}0")) * F.col("scale")), F.lit(0)).cast("int")
    hi = lambda c: F.least(F.ceil((F.col(c) + 1 - F.col(f"{c}0")) * F.col("scale")), F.col("raster")).cast("int")
    boxed = cells.select(*keys, "x", "z", "class", lo("x").alias("a"), hi("x").alias("b"), lo("z").alias("c"), hi("z").alias("d")).where("a < b AND c < d")
    pixels = boxed.withColumn("px", F.explode(F.sequence("a", F.col("b") - 1))).withColumn("pz", F.explode(F.sequence("c", F.col("d") - 1)))
    order = F.struct(G.to_chunk(F.col("z")), G.to_chunk(F.col("x")), "z", "x")
    return pixels.groupBy(*keys, "px", "pz").agg(F.max_by("class", order).alias("class"))


def surface_cover(surface: DataFrame, rasters: DataFrame) -> DataFrame:
    """cover_pixels() of resolved surface cells (x, z, class) for each raster
    (raster_id, x0, z0, scale, raster): a cell goes to the rasters whose square its
    mapchunk meets."""
    far = lambda c: (F.col(c) + F.ceil(F.col("raster") / F.col("scale"))).cast("int")
    reach = lambda c: F.explode(F.sequence(G.to_chunk(F.col(c)), G.to_chunk(far(c))))
    squares = rasters.withColumn("_mx", reach("x0")).withColumn("_mz", reach("z0"))
    met = surface.select("x", "z", "class", G.to_chunk(F.col("x")).alias("_mx"), G.to_chunk(F.col("z")).alias("_mz")).join(squares, ["_mx", "_mz"])
    return cover_pixels(met, ["raster_id"])
