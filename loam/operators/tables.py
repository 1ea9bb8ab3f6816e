"""Derived tables kept by key: what is missing, merged, duplicated, complete."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .dims import is_small, large, small
from .graph import store
from .regions import regions_met
from .tiles import cover_pixels, request_axes


def missing_only(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted keys that are not stored."""
    return wanted.join(stored.select(*keys), keys, "left_anti")


def known_absent(wanted: DataFrame, catalog: DataFrame, complete: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted keys proven absent: not in the catalog, which must be complete.
    complete is one row with a flag of that name."""
    absent = wanted.distinct().join(catalog.select(*keys), keys, "left_anti")
    return absent.join(F.broadcast(complete.select("complete"))).where("complete").drop("complete")


def refresh_merge(valid: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Valid stored rows with the rebuilt ones, told apart by a column rebuilt."""
    return valid.withColumn("rebuilt", F.lit(False)).unionByName(rebuilt.withColumn("rebuilt", F.lit(True)))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys delivered more than once, with how often."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows, once it is known that no key repeats; else an error."""
    found = duplicates(rows, keys).limit(3).collect()
    if found:
        raise ValueError(f"keys delivered more than once: {[tuple(r)[:-1] for r in found]}")
    return rows


def layer_completeness(missing: dict[str, DataFrame]) -> DataFrame:
    """layer, done and the revision's state, from what each layer still misses:
    READY if all are done, PARTIAL if some, else NOT_PREPARED."""
    rows = [df.agg((F.count(F.lit(1)) == 0).alias("done")).select(F.lit(layer).alias("layer"), "done") for layer, df in missing.items()]
    all_ = Window.partitionBy(F.lit(0))  # a row for each layer
    state = F.when(F.min("done").over(all_), "READY").when(F.max("done").over(all_), "PARTIAL").otherwise("NOT_PREPARED")
    return reduce(DataFrame.union, rows).withColumn("revision", state)


def first_kept(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first delivery of each key, by order, with repeats, the number of later
    ones, which don't count."""
    rest = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order])).alias("first")
    return rows.groupBy(*keys).agg(first, (F.count(F.lit(1)) - 1).alias("repeats")).select(*keys, *[F.col(f"first.{c}").alias(c) for c in rest], "repeats")


def in_regions(stored: DataFrame, circles: DataFrame) -> DataFrame:
    """Rows of a stored table partitioned by rx, rz in the regions that circles (cx,
    cz, radius) meet. The join prunes the table's folders when it runs."""
    wanted = regions_met(circles.where("radius >= 0").withColumn("radius", F.col("radius") + 1)).select("rx", "rz").distinct()
    return stored.join(small(wanted), ["rx", "rz"], "left_semi")


def _near(stored: DataFrame, circles: DataFrame) -> DataFrame:
    """Rows of a stored table (rx, rz, x, z, ..) in each circle (cx, cz, radius, ..), with
    what the circle carries. They meet by mapchunk, so neither cells of circles nor
    stored columns are shuffled while circles are few."""
    plan = G.plan_mapchunks(circles.where("radius >= 0"))
    plan = F.broadcast(plan) if is_small(plan) else large(plan)
    keyed = in_regions(stored, circles).drop("rx", "rz").withColumns({"mx": G.to_chunk(F.col("x")), "mz": G.to_chunk(F.col("z"))})
    inside = G.in_circle(*(F.col(c) for c in ("x", "z", "cx", "cz", "radius")))
    return keyed.join(plan, ["mx", "mz"]).where(inside).drop("mx", "mz")


def _held(stored: DataFrame, circles: DataFrame, size_x: int, size_z: int, *kept: str) -> tuple[DataFrame, DataFrame]:
    """circle, x, z with what is stored of the columns kept, or of all, of the circles
    that are served; and circle, served of all. Which are served is known before what
    they give is read: their cells are counted, a column that is stored twice once."""
    kept = kept or tuple(c for c in stored.columns if c not in ("rx", "rz", "x", "z", "size_x", "size_z"))
    circles, at = circles.select("circle", "cx", "cz", "radius").where("cx IS NOT NULL AND cz IS NOT NULL AND radius IS NOT NULL"), ["cx", "cz", "radius"]
    asked = circles.select(*at).distinct()
    fits = F.coalesce((F.col("size_x") == size_x) & (F.col("size_z") == size_z), F.lit(False))
    met = _near(stored.select("rx", "rz", "x", "z", fits.alias("fits")), asked)
    strips = met.groupBy(*at, "x", F.expr("shiftright(z, 6)").alias("strip")).agg(F.expr("bit_or(shiftleft(1L, z & 63))").alias("zs"), F.min("fits").alias("fits"))
    found = strips.groupBy(*at).agg(F.sum(F.bit_count("zs")).alias("n"), F.min("fits").alias("fits"))
    row = lambda d: 2 * F.floor(F.sqrt((F.col("radius").cast("long") * F.col("radius") - d * d).cast("double"))) + 1
    cells = F.aggregate(F.sequence(-F.col("radius").cast("long"), F.col("radius").cast("long")), F.lit(0).cast("long"), lambda n, d: n + row(d))
    inside = [G.in_world(F.col(c) + sign * F.col("radius"), n) for c, n in (("cx", size_x), ("cz", size_z)) for sign in (-1, 1)]
    whole = (F.col("radius") >= 0) & reduce(Column.__and__, inside) & F.coalesce(F.col("fits") & (F.col("n") == cells), F.lit(False))
    gate, _ = store(circles.join(found, at, "left").groupBy("circle").agg(F.min(whole).alias("served")), "gate")
    served = circles.join(gate.where("served"), "circle", "left_semi")
    return _near(stored.select("rx", "rz", "x", "z", *kept), served).select("circle", "x", "z", *kept), gate


def _with_unserved(rows: DataFrame, gate: DataFrame) -> DataFrame:
    """rows of the circles that are served, and a row for each other circle."""
    return rows.withColumn("served", F.lit(True)).unionByName(gate.where("NOT served"), allowMissingColumns=True)


def stored_columns(stored: DataFrame, circles: DataFrame, size_x: int, size_z: int) -> DataFrame:
    """Rows of stored columns (rx, rz, x, z, size_x, size_z, ..) in each circle
    (circle, cx, cz, radius), with served. A circle is served only if it lies in the
    world and every column of it is stored for a world of this size; else it has one
    row whose columns are null, and its caller goes to the source. Only the regions
    that a circle meets are read."""
    joined, gate = _held(stored, circles, size_x, size_z)
    return _with_unserved(joined, gate)


def stored_legend(stored: DataFrame, circles: DataFrame, size_x: int, size_z: int) -> DataFrame:
    """circle, served, state, rock_code, columns of stored rock columns: what
    stored_columns() would give, counted as the circles' cells are read. A circle that can't be served has one row without counts."""
    joined, gate = _held(stored, circles, size_x, size_z, "state", "rock_code")
    counts = joined.groupBy("circle", "state", "rock_code").agg(F.count(F.lit(1)).alias("columns"))
    return _with_unserved(counts, gate)


def stored_pixels(stored: DataFrame, circles: DataFrame, size_x: int, size_z: int) -> DataFrame:
    """circle, served, px, pz, class: the pixels of each circle's raster (circle, cx,
    cz, radius, pixels_per_block) that the stored surface inside it covers; of the
    columns that cover a pixel the last counts, in the order of mapchunk z, mapchunk x,
    z, x. Pixels are made as columns are read, and no column makes a row of its own.
    A circle that can't be served has one row without a pixel."""
    joined, gate = _held(stored, circles, size_x, size_z, "class")
    sized = request_axes(circles).select("circle", "x0", "z0", (F.col("raster") / F.col("width").cast("double")).alias("scale"), "raster")
    pixels = cover_pixels(joined.where("class IS NOT NULL").join(small(sized), "circle"), ["circle"])
    return _with_unserved(pixels, gate)
