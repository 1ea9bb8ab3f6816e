"""Several tables that change together, as one publication.

Each publication writes the regions it touches into a folder of its own, for every
table, then a manifest that names the folder of each region, and last an empty file
whose name is the pointer. Readers take the latest pointer, so they see all tables
before a publication or all after it, whatever fails in between. One writer at a
time; readers may be many.

    path/<table>/version=<v>/rx=../rz=..    rows of the regions that v wrote
    path/manifest/<v>                       rx, rz, version of every region
    path/published/<number>.<v>.<batch>     the pointers
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from ..operators.dims import small

REGION = ["rx", "rz"]


def _file(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    where, files = _file(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []


def pointers(spark: SparkSession, path: str) -> list[tuple[int, str, int | None]]:
    """Number, version and batch of each publication, in order."""
    parts = [n.split(".") for n in _names(spark, f"{path}/published")]
    return [(int(n), version, int(batch) if batch else None) for n, version, batch in parts]


def current(spark: SparkSession, path: str) -> str | None:
    """The version that readers see; None before the first publication."""
    all_ = pointers(spark, path)
    return all_[-1][1] if all_ else None


def noted(spark: SparkSession, path: str, batch: int) -> bool:
    """Whether this batch of a stream, or a later one, has been published."""
    return any(b is not None and b >= batch for _, _, b in pointers(spark, path))


def _manifest(spark: SparkSession, path: str, version: str) -> DataFrame:
    # the condition holds for all; it lets Spark prune folders by what the join finds
    return spark.read.schema("rx int, rz int, version string").parquet(f"{path}/manifest/{version}").where("version > ''")


def read(spark: SparkSession, path: str, table: str, schema: StructType, regions: DataFrame | None = None, version: str | None = None) -> DataFrame:
    """The rows of a table as last published, or as of a version, with rx and rz;
    only those of regions (rx, rz), if given. The manifest prunes the folders."""
    version = version or current(spark, path)
    full = StructType([f for f in schema if f.name not in REGION]).add("version", StringType()).add("rx", IntegerType()).add("rz", IntegerType())
    where, files = _file(spark, f"{path}/{table}")
    if version is None or not files.exists(where):
        return spark.createDataFrame([], full).drop("version")
    wanted = _manifest(spark, path, version)
    if regions is not None:
        wanted = wanted.join(regions.select(*REGION).distinct(), REGION, "left_semi")
    return spark.read.schema(full).parquet(f"{path}/{table}").join(small(wanted), ["version", *REGION], "left_semi").select(*[f.name for f in full if f.name != "version"])


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame], touched: DataFrame, batch: int | None = None) -> str:
    """Publish the whole contents of the touched regions (rx, rz) in every table;
    rows carry rx and rz. All other regions stay as they are."""
    version, before = uuid.uuid4().hex, current(spark, path)
    for name, rows in tables.items():
        rows.hint("rebalance", *REGION).write.partitionBy(*REGION).parquet(f"{path}/{name}/version={version}")
    manifest = touched.select(*REGION).distinct().withColumn("version", F.lit(version))
    if before is not None:
        manifest = manifest.unionByName(_manifest(spark, path, before).join(manifest.select(*REGION), REGION, "left_anti"))
    manifest.write.parquet(f"{path}/manifest/{version}")
    number = len(pointers(spark, path))
    where, files = _file(spark, f"{path}/published/{number:012d}.{version}.{'' if batch is None else batch}")
    files.create(where, False).close()  # from here on readers see it
    return version


def vacuum(spark: SparkSession, path: str, tables) -> int:
    """Delete folders that the current version doesn't read, those of publications
    that failed among them; returns their number. For when no reader is at an older
    version and no writer at work."""
    now = current(spark, path)
    used = {r.version for r in _manifest(spark, path, now).select("version").distinct().collect()} if now else set()
    old = [f"{path}/{t}/{n}" for t in tables for n in _names(spark, f"{path}/{t}") if n.startswith("version=") and n.removeprefix("version=") not in used]
    old += [f"{path}/manifest/{n}" for n in _names(spark, f"{path}/manifest") if n != now]
    for p in old:
        where, files = _file(spark, p)
        files.delete(where, True)
    return len(old)
