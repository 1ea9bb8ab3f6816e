"""Derived tables on storage, partitioned so that a refresh replaces by region."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.dims import large, small
from ..operators.graph import drop, store
from ..operators.tables import missing_only, require_unique
from . import decode, published

#: The two tables of the resource index.
OCCURRENCES, COVERAGE = "occurrences", "chunk_cov"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def publish(rows: DataFrame, path: str, partitions: list[str]) -> None:
    """Write rows; only the partitions they touch are replaced. Rows are dealt by
    partition, and Spark splits one that is much larger than the others."""
    (rows.hint("rebalance", *partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path))


def with_region(rows: DataFrame, x: str = "x", z: str = "z") -> DataFrame:
    """rows with the region (rx, rz) of their block coordinates."""
    return rows.withColumns({"rx": G.to_region(G.to_chunk(F.col(x))), "rz": G.to_region(G.to_chunk(F.col(z)))})


def write_terrain(heights: DataFrame, path: str) -> None:
    publish(with_region(heights), path, ["rx", "rz"])


def write_surface(surface: DataFrame, path: str, columns: int = 1024) -> None:
    """Whole mapchunks only: one clipped by a request is an error."""
    per = surface.groupBy(G.to_chunk(F.col("x")).alias("mx"), G.to_chunk(F.col("z")).alias("mz")).agg(F.countDistinct("x", "z").alias("n"))
    if not per.where(F.col("n") != columns).isEmpty():
        raise ValueError("surface tiles must be whole mapchunks")
    publish(with_region(surface), path, ["rx", "rz"])


def surface_tiles(surface: DataFrame, mapchunks: DataFrame) -> DataFrame:
    """All 1,024 columns (x, z) of each mapchunk (mx, mz) with their surface class,
    null where a column has none: what a stored tile holds."""
    local = lambda m: F.explode(F.sequence(F.col(m) * G.CHUNK, F.col(m) * G.CHUNK + G.CHUNK - 1))
    grid = mapchunks.select("mx", "mz").distinct().withColumn("x", local("mx")).select("x", local("mz").alias("z"))
    return grid.join(surface.select("x", "z", "class"), ["x", "z"], "left")


def write_upper_rock(columns: DataFrame, path: str) -> None:
    publish(with_region(columns), path, ["rx", "rz"])


def write_region_profiles(profiles: DataFrame, path: str) -> None:
    """The profiles, and after them the mark that their scan is complete."""
    publish(profiles, f"{path}/profiles", ["rx", "rz"])
    profiles.sparkSession.range(1).select(F.lit("regions").alias("layer"), F.lit(True).alias("complete")).write.mode("overwrite").parquet(f"{path}/layer_status")


def write_resource_index(occurrences: DataFrame, coverage: DataFrame, path: str, batch: int | None = None) -> None:
    """Publish coverage (cx, cy, cz, status, ..) of chunks and the occurrences of the
    AVAILABLE ones, in one publication: what was stored of these chunks goes, all
    other chunks stay. A chunk delivered twice is an error."""
    spark, keys = coverage.sparkSession, ["cx", "cy", "cz"]
    region = {"rx": G.to_region(F.col("cx")), "rz": G.to_region(F.col("cz"))}
    coverage = require_unique(coverage, keys).withColumns(region)
    touched = coverage.select("rx", "rz").distinct()
    usable = occurrences.join(coverage.where("status = 'AVAILABLE'").select(*keys), keys, "left_semi").withColumns(region)
    tables = {}
    for name, new in ((OCCURRENCES, usable), (COVERAGE, coverage)):
        old = published.read(spark, path, name, new.schema, touched)
        tables[name] = missing_only(old, coverage, keys).unionByName(new)
    published.publish(spark, path, tables, touched, batch)


def write_catalog(observed: DataFrame, path: str, keys: list[str], complete: bool = False) -> None:
    """Append the keys that are not there yet; the complete mark comes last."""
    spark, new = observed.sparkSession, observed.select(*keys).distinct()
    where = f"{path}/keys"
    if exists(spark, where):
        new = missing_only(new, spark.read.schema(new.schema).parquet(where), keys)
    new.write.mode("append").parquet(where)
    if complete:
        spark.range(1).select(F.lit(True).alias("complete")).write.mode("overwrite").parquet(f"{path}/complete")


def load_tile(asked: DataFrame, raw: DataFrame, terrain_path: str, surface_path: str) -> DataFrame:
    """mx, mz, source, heights, surface, terrain_complete, surface_complete of the
    mapchunks (mx, mz) that a tile asks for.

    What is stored is taken from there (STORED). The other mapchunks are looked up
    in raw (position, data): PRESENT_DECODED ones are stored for the next time,
    PRESENT_UNREADABLE and ABSENT ones have no heights. A surface is only taken from
    its store. The complete flags say whether every mapchunk has what it needs.
    """
    spark, keys = asked.sparkSession, ["mx", "mz"]
    at = [G.to_chunk(F.col("x")).alias("mx"), G.to_chunk(F.col("z")).alias("mz")]

    asked = asked.select(*keys).distinct().where("mx IS NOT NULL")
    wanted = asked.select(G.to_region(F.col("mx")).alias("rx"), G.to_region(F.col("mz")).alias("rz")).distinct()
    near, _ = store(wanted, "wanted")

    def stored(path: str, name: str) -> DataFrame:
        if not exists(spark, path):
            return spark.createDataFrame([], f"mx int, mz int, {name} long")
        rows = spark.read.parquet(path).join(small(near.where("rx > -2147483648")), ["rx", "rz"], "left_semi")  # prunes folders as it runs
        return rows.select(*at).join(small(asked), keys, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    hits, _ = store(asked.join(stored(terrain_path, "heights"), keys), "hits")  # before anything is added
    surfaces = asked.join(stored(surface_path, "surface"), keys)
    found, _ = store(decode.mapchunk_status(asked.join(hits, keys, "left_anti"), raw), "found")
    index = F.posexplode(F.arrays_zip(F.coalesce("rain", "terrain").alias("rain"), F.coalesce("terrain", "rain").alias("terrain"))).alias("i", "h")
    new = found.where("read_status = 'PRESENT_DECODED'").select(*keys, index)
    place = lambda m, i: (F.col(m) * G.CHUNK + i).cast("int")
    tiles = new.select(place("mx", F.col("i") % G.CHUNK).alias("x"), place("mz", F.floor(F.col("i") / G.CHUNK)).alias("z"), F.col("h.rain").alias("rain_y"), F.col("h.terrain").alias("terrain_y"))
    with_region(tiles).write.mode("append").partitionBy("rx", "rz").parquet(terrain_path)
    read = found.select(*keys, F.col("read_status").alias("source"), F.when(F.col("read_status") == "PRESENT_DECODED", 1024).otherwise(0).cast("long").alias("heights"))
    rows = hits.select(*keys, F.lit("STORED").alias("source"), "heights").unionByName(read)
    rows = rows.join(surfaces, keys, "left").withColumn("surface", F.coalesce("surface", F.lit(0)))
    whole = rows.agg(F.min(F.col("heights") > 0).alias("terrain_complete"), F.min(F.col("surface") > 0).alias("surface_complete"))
    return rows.join(F.broadcast(whole))  # one row


def prepare(wanted: dict[str, DataFrame], build: dict, path: str, keys: dict[str, list[str]], stop=None) -> dict[str, int]:
    """Bring derived layers up to date: for each layer, in order, build(missing
    keys) makes the rows of the wanted keys not stored yet; they are appended,
    then the layer's status row is written. Returns the rows added; a second run
    adds none. stop(layer), asked before each layer, ends the run; what is stored,
    of this layer and later ones too, stays as it was."""
    added = {}
    for layer, want in wanted.items():
        if stop is not None and stop(layer):
            break
        spark, where, k = want.sparkSession, f"{path}/{layer}", keys[layer]
        todo, added[layer] = want.select(*k).distinct(), 0
        if exists(spark, where):
            todo = missing_only(todo, large(spark.read.parquet(where)), k)
        todo, todo_path = store(todo, "todo")
        if not todo.isEmpty():
            rows = Observation()  # counted as they are written
            build[layer](todo).observe(rows, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(where)
            added[layer] = rows.get.get("n", 0)
        drop(spark, todo_path)
        spark.range(1).select(F.lit(layer).alias("layer"), F.lit(True).alias("complete")).write.mode("overwrite").parquet(f"{path}/status/{layer}")
    return added


def prepared(spark: SparkSession, path: str, layers) -> DataFrame:
    """layer, complete of each layer, from the status rows stored so far."""
    rows = [spark.read.parquet(f"{path}/status/{n}") if exists(spark, f"{path}/status/{n}") else spark.range(1).select(F.lit(n).alias("layer"), F.lit(False).alias("complete")) for n in layers]
    return reduce(DataFrame.unionByName, rows)
