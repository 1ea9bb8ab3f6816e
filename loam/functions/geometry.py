"""Coordinate columns: chunks, regions, tiles, packed keys, circles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 32
REGION_CHUNKS = 16
REGION = CHUNK * REGION_CHUNKS
#: Blocks to a pixel at each level of detail, 0 to 5.
LODS = (1, 2, 4, 8, 16, 32)


def to_chunk(v: Column) -> Column:
    """Chunk coordinate of a world coordinate, floored also below zero."""
    return F.floor(F.floor(v) / CHUNK).cast("int")


def to_region(chunk: Column) -> Column:
    return F.floor(chunk / REGION_CHUNKS).cast("int")


def to_tile(chunk: Column, span: int) -> Column:
    return F.floor(chunk / span).cast("int")


def local(v: Column) -> Column:
    """Place inside the chunk, 0 to 31."""
    return F.pmod(v, F.lit(CHUNK)).cast("int")


def column_index(x: Column, z: Column) -> Column:
    return local(z) * CHUNK + local(x)


def voxel_index(x: Column, y: Column, z: Column) -> Column:
    return (local(y) * CHUNK + local(z)) * CHUNK + local(x)


def to_display(v: Column, size: int) -> Column:
    """Absolute to display coordinate; the world's middle is the origin."""
    return v - size / 2


def from_display(v: Column, size: int) -> Column:
    return v + size / 2


def half_up(v: Column) -> Column:
    """Nearest integer, halves towards positive infinity."""
    return F.floor(v + 0.5).cast("long")


def in_circle(x: Column, z: Column, cx: Column, cz: Column, radius: Column) -> Column:
    """Inside or on the circle; the box conditions let Parquet statistics prune."""
    dx, dz, r = (x - cx).cast("long"), (z - cz).cast("long"), radius.cast("long")
    box = x.between(cx - radius, cx + radius) & z.between(cz - radius, cz + radius)
    return box & (dx * dx + dz * dz <= r * r)


def touches_circle(lo_x: Column, hi_x: Column, lo_z: Column, hi_z: Column, cx: Column, cz: Column, radius: Column) -> Column:
    """Whether the rectangle, bounds included, has a point in the circle."""
    dx = cx - F.greatest(lo_x, F.least(cx, hi_x))
    dz = cz - F.greatest(lo_z, F.least(cz, hi_z))
    return dx.cast("long") * dx + dz.cast("long") * dz <= radius.cast("long") * radius


def in_world(v: Column, size: int) -> Column:
    return (v >= 0) & (v < size)


def in_y_range(y: Column, low: Column, high: Column) -> Column:
    """Inclusive; a null bound is open."""
    return (low.isNull() | (y >= low)) & (high.isNull() | (y <= high))


def y_range_text(low: Column, high: Column) -> Column:
    lo, hi = low.cast("string"), high.cast("string")
    return (
        F.when(low.isNull() & high.isNull(), "all")
        .when(low.isNull(), F.concat(F.lit("<="), hi))
        .when(high.isNull(), F.concat(F.lit(">="), lo))
        .otherwise(F.concat(lo, F.lit(".."), hi))
    )


# -- packed chunk keys: x 21 bits, guard, dimension 5, z 21, guard, dimension 5, y 9, reserved

_COORDINATE, _LOW5, _Y = (1 << 21) - 1, 31, 511


def encode_position(x: Column, y: Column, z: Column, dim: Column) -> Column:
    """The packed key, null where a part is out of range."""
    far = 1 << 20
    fits = x.between(-far, far - 1) & z.between(-far, far - 1) & y.between(0, 511) & dim.between(0, 1023)
    part = lambda v, mask, by: F.shiftleft(v.cast("long").bitwiseAND(F.lit(mask).cast("long")), by)
    key = (
        part(x, _COORDINATE, 0)
        .bitwiseOR(part(dim, _LOW5, 22))
        .bitwiseOR(part(z, _COORDINATE, 27))
        .bitwiseOR(part(F.shiftright(dim, 5), _LOW5, 49))
        .bitwiseOR(part(y, _Y, 54))
    )
    return F.when(fits, key)


def decode_position(key: Column) -> Column:
    """struct(x, y, z, dim); null where a guard or reserved bit is set."""
    bits = lambda by, mask: F.shiftrightunsigned(key, by).bitwiseAND(F.lit(mask).cast("long"))
    signed = lambda v: F.when(v >= 1 << 20, v - (1 << 21)).otherwise(v).cast("int")
    clean = (bits(21, 1) == 0) & (bits(48, 1) == 0) & (bits(63, 1) == 0)
    dim = bits(22, _LOW5).bitwiseOR(F.shiftleft(bits(49, _LOW5), 5)).cast("int")
    return F.when(clean, F.struct(signed(bits(0, _COORDINATE)).alias("x"), bits(54, _Y).cast("int").alias("y"), signed(bits(27, _COORDINATE)).alias("z"), dim.alias("dim")))


# -- planners: rows of requests become rows of positions


def with_chunks(rows: DataFrame) -> DataFrame:
    """rows (x, z, ..) with the chunk column (cx, cz) they lie in. Columns of that name
    that are there already stay as they are: a table may be stored in buckets of them."""
    return rows.withColumns({n: to_chunk(F.col(c)) for n, c in (("cx", "x"), ("cz", "z")) if n not in rows.columns})


def dealt_out(rows: DataFrame, *keys: str) -> DataFrame:
    """Few rows that are about to become many, over as many tasks as a shuffle has;
    a stated number is one that Spark doesn't make smaller because the rows are few."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def circle_cells(requests: DataFrame) -> DataFrame:
    """Every cell (x, z) of each request's inclusive circle (cx, cz, radius). The rows
    of a circle are dealt out before their cells are made, so a large circle is the
    work of many tasks."""
    rows = requests.withColumn("z", F.explode(F.sequence(F.col("cz") - F.col("radius"), F.col("cz") + F.col("radius"))))
    rows = dealt_out(rows, "z")
    dz = (F.col("z") - F.col("cz")).cast("long")
    half = F.floor(F.sqrt((F.col("radius").cast("long") * F.col("radius") - dz * dz).cast("double"))).cast("int")
    return rows.withColumn("x", F.explode(F.sequence(F.col("cx") - half, F.col("cx") + half)))


def _span(low: Column, high: Column) -> Column:
    """low..high, empty where high is below low."""
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def plan_mapchunks(requests: DataFrame, size_x: int | None = None, size_z: int | None = None) -> DataFrame:
    """Mapchunks (mx, mz) whose blocks touch each request's circle, of a world of
    that size if it is given."""

    def axis(c, size):
        low, high = to_chunk(F.col(c) - F.col("radius")), to_chunk(F.col(c) + F.col("radius"))
        return _span(low, high) if size is None else _span(F.greatest(low, F.lit(0)), F.least(high, F.lit((size - 1) // CHUNK)))

    def edge(m, size):
        last = F.col(m) * CHUNK + CHUNK - 1
        return last if size is None else F.least(last, F.lit(size - 1))

    grid = requests.withColumn("mx", F.explode(axis("cx", size_x))).withColumn("mz", F.explode(axis("cz", size_z)))
    return grid.where(touches_circle(F.col("mx") * CHUNK, edge("mx", size_x), F.col("mz") * CHUNK, edge("mz", size_z), F.col("cx"), F.col("cz"), F.col("radius")))


def plan_chunks(requests: DataFrame, size_x: int, size_y: int, size_z: int) -> DataFrame:
    """Chunks (mx, my, mz) that also meet the inclusive range y_min to y_max."""
    low = F.greatest(F.coalesce(F.col("y_min"), F.lit(0)), F.lit(0))
    high = F.least(F.coalesce(F.col("y_max"), F.lit(size_y - 1)), F.lit(size_y - 1))
    return plan_mapchunks(requests, size_x, size_z).withColumn("my", F.explode(F.when(low <= high, F.sequence(to_chunk(low), to_chunk(high))).otherwise(F.array().cast("array<int>"))))


def plan_window(requests: DataFrame, size_x: int, size_z: int) -> DataFrame:
    """Square window of mapchunks, at least one each way, clipped to the world."""
    reach = F.greatest(F.ceil(F.col("radius") / CHUNK), F.lit(1)).cast("int")
    axis = lambda c, size: _span(F.greatest(to_chunk(F.col(c)) - reach, F.lit(0)), F.least(to_chunk(F.col(c)) + reach, F.lit((size - 1) // CHUNK)))
    return requests.withColumn("mx", F.explode(axis("cx", size_x))).withColumn("mz", F.explode(axis("cz", size_z)))


def plan_full_height(mapchunks: DataFrame, size_y: int) -> DataFrame:
    """All vertical chunks my of each mapchunk."""
    return mapchunks.withColumn("my", F.explode(F.sequence(F.lit(0), F.lit(-(-size_y // CHUNK) - 1))))


def rect_clip(rects: DataFrame, size_x: int, size_z: int) -> DataFrame:
    """Half-open rectangles (x0, x1, z0, z1) cut to the world, with one row for
    each mapchunk (mx, mz) they meet; rectangles outside the world have none."""
    cut = rects.withColumns({
        "x0": F.greatest("x0", F.lit(0)), "x1": F.least("x1", F.lit(size_x)), "z0": F.greatest("z0", F.lit(0)), "z1": F.least("z1", F.lit(size_z))})
    cut = cut.where("x0 < x1 AND z0 < z1")
    axis = lambda a, b: F.explode(F.sequence(to_chunk(F.col(a)), to_chunk(F.col(b) - 1)))
    return cut.withColumn("mx", axis("x0", "x1")).withColumn("mz", axis("z0", "z1"))


def square_ring(centres: DataFrame) -> DataFrame:
    """Tiles (rx, rz) at Chebyshev distance d of (tx, tz), numbered clockwise
    from the north-west corner."""
    d = F.col("d")
    side = F.when(d == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), 8 * d - 1))
    at = centres.withColumn("place", F.explode(side))
    i, n = F.col("place"), 2 * d
    dx = F.when(i <= n, i - d).when(i <= 2 * n, d).when(i <= 3 * n, 3 * n - i - d).otherwise(-d)
    dz = F.when(i <= n, -d).when(i <= 2 * n, i - n - d).when(i <= 3 * n, d).otherwise(4 * n - i - d)
    return at.withColumn("rx", F.when(d == 0, F.col("tx")).otherwise(F.col("tx") + dx).cast("int")).withColumn("rz", F.when(d == 0, F.col("tz")).otherwise(F.col("tz") + dz).cast("int"))


def inner_cells(cells: DataFrame, size=18, pad_low=1, pad_high=1) -> DataFrame:
    """Cells (rx, rz, lx, lz) inside the padding, with their world rectangle, whose
    edges need not be whole blocks. Size and paddings are numbers, or columns where
    each map has its own."""
    size, low, high = (v if isinstance(v, Column) else F.lit(v) for v in (size, pad_low, pad_high))
    inner = size - low - high
    kept = cells.where(F.col("lx").between(low, size - high - 1) & F.col("lz").between(low, size - high - 1))
    edge = lambda r, c, more: F.col(r) * REGION + (F.col(c) - low + more) * float(REGION) / inner
    return kept.withColumns({"x0": edge("rx", "lx", 0), "x1": edge("rx", "lx", 1), "z0": edge("rz", "lz", 0), "z1": edge("rz", "lz", 1)})


def nearest_lod(pixels_per_block: Column) -> Column:
    """Level whose blocks to a pixel are nearest by ratio; ties to the finer."""
    wish = 1.0 / pixels_per_block
    far = lambda b: F.abs(F.ln(F.lit(float(b)) / wish) / F.ln(F.lit(2.0)))
    return F.array_min(F.array(*[F.struct(far(b).alias("far"), F.lit(i).alias("lod")) for i, b in enumerate(LODS)]))["lod"]
