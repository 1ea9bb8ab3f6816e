"""Region layers: climate, forest and id summaries, signals, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import geometry as G

REGION_KEYS = ("rx", "rz")


def climate_summary(inner: DataFrame) -> DataFrame:
    """Per region: cells, mean temperature and rain of the inner climate cells."""
    t, r = C.climate_bits(F.col("raw"))
    return inner.where("layer = 'climate'").groupBy(*REGION_KEYS).agg(F.count(F.lit(1)).alias("cells"), F.avg(t).alias("temperature"), F.avg(r).alias("rain"))


def forest_summary(inner: DataFrame) -> DataFrame:
    """Per region: cells, least, most, mean density and its class."""
    s = inner.where("layer = 'forest'").groupBy(*REGION_KEYS).agg(
        F.count(F.lit(1)).alias("cells"), F.min("raw").alias("low"), F.max("raw").alias("high"), C.mean_density(F.col("raw")).alias("density"))
    return s.withColumn("class", C.forest_class(C.forest_density(F.floor(F.col("density") * 255 + 0.5))))


def value_summary(inner: DataFrame, layer: str) -> DataFrame:
    """Per region: cells, least, most and mean value of a layer."""
    return inner.where(F.col("layer") == layer).groupBy(*REGION_KEYS).agg(
        F.count(F.lit(1)).alias("cells"), F.min("raw").alias("low"), F.max("raw").alias("high"), F.avg("raw").alias("mean"))


def id_summary(inner: DataFrame, layer: str, top: int = 8) -> DataFrame:
    """Per region: samples, distinct ids and the top ids (id, cells, place), by
    count, ties by id."""
    counts = inner.where(F.col("layer") == layer).groupBy(*REGION_KEYS, F.col("raw").alias("id")).agg(F.count(F.lit(1)).alias("cells"))
    region = Window.partitionBy(*REGION_KEYS)
    place = F.row_number().over(region.orderBy(F.desc("cells"), "id"))
    all_ = counts.select("*", F.sum("cells").over(region).alias("samples"), F.count(F.lit(1)).over(region).alias("ids"), place.alias("place"))
    return all_.where(F.col("place") <= top)


def first_values(inner: DataFrame, layer: str, n: int = 8) -> DataFrame:
    """Per region: the first n values in z, x order, as an array."""
    order = Window.partitionBy(*REGION_KEYS).orderBy("lz", "lx")
    first = inner.where(F.col("layer") == layer).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    return first.groupBy(*REGION_KEYS).agg(F.array_sort(F.collect_list(F.struct("place", "raw"))).alias("v")).select(*REGION_KEYS, F.expr("transform(v, s -> s.raw)").alias("first_raw"))


def resource_keys(inner: DataFrame) -> DataFrame:
    """Distinct signal keys: layers named ore:<key>."""
    return inner.where(F.col("layer").startswith("ore:")).select(F.expr("substr(layer, 5)").alias("resource")).distinct()


def signal_dataset(inner: DataFrame) -> DataFrame:
    """Per resource over all regions: least, most, mean, distinct values, regions."""
    s = inner.where(F.col("layer").startswith("ore:")).withColumn("resource", F.expr("substr(layer, 5)"))
    return s.groupBy("resource").agg(
        F.min("raw").alias("low"), F.max("raw").alias("high"), F.avg("raw").alias("mean"), F.countDistinct("raw").alias("values"),
        F.countDistinct(F.struct(*REGION_KEYS)).alias("regions"))


def signal_relative(inner: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Signal cells with relative = (raw - low) / (high - low), 0 where flat, of
    at least threshold. The bounds are one row for each resource."""
    bounds = signal_dataset(inner).select("resource", "low", "high")
    s = inner.where(F.col("layer").startswith("ore:")).withColumn("resource", F.expr("substr(layer, 5)"))
    joined = s.join(bounds, "resource")
    relative = F.when(F.col("high") == F.col("low"), 0.0).otherwise((F.col("raw") - F.col("low")) / (F.col("high") - F.col("low")))
    return joined.withColumn("relative", relative).where((F.col("relative") >= threshold) & (F.col("relative") <= 1)).drop("low", "high")


def _axis(c: str, radius: str = "radius"):
    """Regions that the open interval of a square's side meets."""
    low = F.floor((F.col(c) - F.col(radius)) / G.REGION)
    high = F.ceil((F.col(c) + F.col(radius)) / G.REGION) - 1
    return F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))


def regions_met(requests: DataFrame) -> DataFrame:
    """requests (cx, cz, radius) once for each region (rx, rz) their square meets."""
    return requests.withColumn("rx", F.explode(_axis("cx"))).withColumn("rz", F.explode(_axis("cz")))


def max_signal(signals: DataFrame, requests: DataFrame) -> DataFrame:
    """Highest relative signal of each requested resource among the cells whose
    centre lies in the circle; null if none. A request meets the cells of the
    regions around it, whatever the number of requests."""
    best = signals_in_area(signals, requests).groupBy("request_id", "resource").agg(F.max("relative").alias("signal"))
    return requests.select("request_id", "resource").join(best, ["request_id", "resource"], "left")


def signals_in_area(signals: DataFrame, requests: DataFrame) -> DataFrame:
    """Signal cells of each request's resource whose centre lies in its circle."""
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2
    near = signals.join(regions_met(requests.withColumn("radius", F.col("radius") + 1)).drop("radius"), ["rx", "rz", "resource"]).join(
        requests.select("request_id", "resource", "radius"), ["request_id", "resource"])
    dx, dz = middle("x0", "x1") - F.col("cx"), middle("z0", "z1") - F.col("cz")
    return near.where(dx * dx + dz * dz <= F.col("radius").cast("double") * F.col("radius"))


def region_window(regions: DataFrame, requests: DataFrame) -> DataFrame:
    """Regions whose rectangle meets each request's square, half open."""
    return regions.join(regions_met(requests), list(REGION_KEYS))


def overlay_counts(regions: DataFrame, requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per request: regions considered, drawn (with a profile) and without data."""
    met = region_window(regions, requests).join(profiles.select(*REGION_KEYS, F.lit(1).alias("has")), list(REGION_KEYS), "left")
    return met.groupBy("request_id").agg(F.count(F.lit(1)).alias("considered"), F.count("has").alias("drawn"), F.count_if(F.col("has").isNull()).alias("without_data"))


#: Layers whose values are ids, and those whose values are amounts.
ID_LAYERS, TOP_IDS = ("landform", "province"), 8


def environment_profiles(inner: DataFrame, top: int = TOP_IDS) -> DataFrame:
    """Per region with any of the layers: climate and forest means and class, ocean's
    range and mean, samples, different ids and the top ids of landforms and
    provinces, and labels. What a region lacks is null.

    One pass for all layers: cells are dealt by region, equal values of a layer are
    counted, and a region's few hundred counts make its row; the ids of a layer come
    from their counts, most frequent first, ties by id.
    """
    t, r = C.climate_bits(F.col("raw"))
    counts = inner.where(F.col("layer").isin("climate", "forest", "ocean", *ID_LAYERS) & F.col("raw").isNotNull()).repartition(*REGION_KEYS).groupBy(*REGION_KEYS, "layer", "raw").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    of = lambda layer, c: F.when(F.col("layer") == layer, c)
    cells = lambda layer: F.sum(of(layer, n))
    mean = lambda layer, c: F.sum(of(layer, c * n)).cast("double") / cells(layer)
    bounded = F.greatest(F.lit(0), F.least(F.lit(255), F.col("raw")))
    out = [cells("climate").alias("climate_cells"), mean("climate", t).alias("temperature"), mean("climate", r).alias("rain"), cells("forest").alias("forest_cells"), (mean("forest", bounded) / 255.0).alias("density")]
    out += [cells("ocean").alias("ocean_cells"), F.min(of("ocean", F.col("raw"))).alias("ocean_low"), F.max(of("ocean", F.col("raw"))).alias("ocean_high"), mean("ocean", F.col("raw").cast("long")).alias("ocean_mean")]
    for layer in ID_LAYERS:
        ranked = F.array_sort(F.collect_list(of(layer, F.struct((-n).alias("less"), "raw"))))
        ids = F.transform(F.slice(ranked, 1, top), lambda s: s["raw"])
        out += [cells(layer).alias(f"{layer}_cells"), F.nullif(F.count(of(layer, F.lit(1))), F.lit(0)).alias(f"{layer}_ids"), F.when(cells(layer).isNotNull(), ids).alias(f"{layer}_top")]
    rows = counts.groupBy(*REGION_KEYS).agg(*out)
    density = C.forest_density(F.floor(F.col("density") * 255 + 0.5))
    named = rows.withColumn("forest_class", F.when(density.isNotNull(), C.forest_class(density)))
    return named.withColumn("labels", C.environment_labels(F.col("temperature"), F.col("rain"), F.col("density")))


def coverage_cells(regions: DataFrame, size_x: int, size_z: int) -> DataFrame:
    """Every cell of the regions' bounding grid: present, world and display bounds."""
    present = regions.select("rx", "rz").distinct()
    box = present.agg(F.min("rx").alias("a"), F.max("rx").alias("b"), F.min("rz").alias("c"), F.max("rz").alias("d")).where("a IS NOT NULL")
    lines = G.dealt_out(box.select(F.explode(F.sequence("a", "b")).alias("rx"), "c", "d"), "rx")
    grid = lines.select("rx", F.explode(F.sequence("c", "d")).alias("rz"))
    cells = grid.join(present.withColumn("_p", F.lit(True)), ["rx", "rz"], "left")
    return cells.select(
        "rx", "rz", F.coalesce("_p", F.lit(False)).alias("present"),
        (F.col("rx") * G.REGION).alias("x0"), (F.col("rz") * G.REGION).alias("z0"), ((F.col("rx") + 1) * G.REGION).alias("x1"), ((F.col("rz") + 1) * G.REGION).alias("z1"),
        G.to_display(F.col("rx") * G.REGION, size_x).alias("display_x0"), G.to_display(F.col("rz") * G.REGION, size_z).alias("display_z0"))


def coverage_summary(regions: DataFrame) -> DataFrame:
    """One row: grid bounds and size, present, missing, percent; zeros if empty."""
    s = regions.select("rx", "rz").distinct().agg(
        F.min("rx").alias("min_rx"), F.max("rx").alias("max_rx"), F.min("rz").alias("min_rz"), F.max("rz").alias("max_rz"), F.count(F.lit(1)).alias("present"))
    s = s.withColumns({"width": F.col("max_rx") - F.col("min_rx") + 1, "height": F.col("max_rz") - F.col("min_rz") + 1})
    s = s.withColumn("possible", F.col("width").cast("long") * F.col("height"))
    s = s.withColumns({"missing": F.col("possible") - F.col("present"), "percent": F.col("present") * 100.0 / F.col("possible")})
    return s.select(*[F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in s.dtypes])


def key_runs(keys: DataFrame, key: str) -> DataFrame:
    """Contiguous runs of distinct integer keys: first_key, last_key, n.

    Islands are found inside ranges of 2^16 keys. Those that touch the edge of their
    range, two at most for each, are joined inside ranges of 2^32 keys, then 2^48,
    then all: no task has more than 2^17 of them.
    """
    ranges = lambda c, bits: F.shiftright(c, bits)
    parts = keys.select(F.col(key).cast("long").alias("k")).where("k IS NOT NULL").distinct().withColumn("part", ranges("k", 16))
    island = F.col("k") - F.row_number().over(Window.partitionBy("part").orderBy("k"))
    open_ = parts.withColumn("island", island).groupBy("part", "island").agg(F.min("k").alias("a"), F.max("k").alias("b")).select("a", "b")
    done = None
    for bits in (16, 32, 48):
        low = F.shiftleft(ranges("a", bits), bits)
        at_edge = (F.col("a") == low) | (F.col("b") == low + ((1 << bits) - 1))
        inner = open_.where(~at_edge)
        done = inner if done is None else done.unionByName(inner)
        open_ = _touching(open_.where(at_edge).withColumn("part", ranges("a", bits + 16) if bits < 48 else F.lit(0)))
    done = done.unionByName(open_)
    return done.select(F.col("a").alias("first_key"), F.col("b").alias("last_key"), (F.col("b") - F.col("a") + 1).alias("n"))


def _touching(runs: DataFrame) -> DataFrame:
    """Runs (a, b) of each part, those that follow each other directly as one."""
    order = Window.partitionBy("part").orderBy("a")
    starts = runs.withColumn("new", F.coalesce((F.col("a") != F.lag("b", 1).over(order) + 1).cast("int"), F.lit(1)))
    grouped = starts.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("part", "run").agg(F.min("a").alias("a"), F.max("b").alias("b")).select("a", "b")
