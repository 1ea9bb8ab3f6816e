"""World-shaped views over the supplied tables, the same text for both engines.

The supplied tables hold no worlds; these views derive one from them, so every
operator can be checked against SQL. The world is 128 blocks high and 96 wide, and
has a strip of 96 blocks for every STRIP_ROWS rows of lineitem, with the requests,
arrivals and regions that belong to it, so the work grows with the tables.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.graph import store

STRIP, SIZE_Y, SIZE_Z = 96, 128, 96
STRIP_ROWS = 50_000
#: Rows of lineitem to a task that takes the greatest block of its places, so that a
#: task's memory doesn't grow with the table.
TASK_ROWS = 500_000

#: For DuckDB, what the views take from the number of rows: :scale strips.
EXTENT = f"extent AS (SELECT greatest(1, count(*) // {STRIP_ROWS})::INT AS scale FROM lineitem)"
SCALE_SQL = "(SELECT scale FROM extent)"
#: Ranges over the world's columns and mapchunks, for the FROM of a query.
COLUMNS_X, MAPCHUNKS_X = "(SELECT unnest(range(0, 96 * scale)) AS x FROM extent) a", "(SELECT unnest(range(0, 3 * scale)) AS mx FROM extent) a"

#: Blocks before the greatest of a place is taken.
PLACED = """\
 SELECT CAST(l_orderkey % (96 * :scale) AS INT) AS x,
        CAST((l_suppkey*7 + l_linenumber*13 + CAST(floor(l_quantity) AS BIGINT)) % 128 AS INT) AS y,
        CAST(l_partkey % 96 AS INT) AS z,
        CAST((l_partkey*5 + l_linenumber*3 + CAST(floor(l_quantity) AS BIGINT)) % 32 AS INT) AS block_id
 FROM {lineitem}"""

VIEWS = {
    "registry": """
SELECT * FROM (VALUES
 (0,'game:air'),(1,'game:rock-granite'),(2,'game:rock-basalt'),(3,'rock-limestone'),
 (4,'game:rock-sandstone'),(5,'game:ore-poor-nativecopper-granite'),
 (6,'game:ore-rich-nativecopper-basalt'),(7,'ore-medium-cassiterite-granite'),
 (8,'mod:ore-rich-galena-limestone'),(9,'game:forestfloor-3'),(10,'game:soil-medium-normal'),
 (11,'game:soil-high-none'),(12,'game:soil-compost-sparse'),(13,'game:bonysoil'),
 (14,'game:bonysoil-4'),(15,'game:farmland-dry-low'),(16,'game:tallgrass-medium-free'),
 (17,'game:leaves-grown-oak'),(18,'game:water-still-7'),(19,'game:snowblock'),
 (20,'game:sand-granite'),(21,'game:gravel-basalt'),(22,'game:rawclay-fire-none'),
 (23,'game:rawclay-blue-none'),(24,'game:peat-none'),
 (25,'game:looseores-nativecopper-granite-free'),(26,'game:looseflints-granite-free'),
 (27,'game:loosestones-basalt-snow'),(28,'game:looseboulders-limestone-free'),
 (29,'mod:machine-coil'),(30,'game:soil-low-verysparse')) AS t(block_id, code)""",
    "voxels": """
SELECT x, y, z, max(block_id) AS block_id FROM (
""" + PLACED + """) v GROUP BY x, y, z""",
    "chunk_cov": """
SELECT cx, cy, cz, CASE (cx*5 + cy*7 + cz*11) % 13 WHEN 0 THEN 'MISSING' WHEN 1 THEN 'FAILED' ELSE 'AVAILABLE' END AS status
FROM (SELECT DISTINCT CAST(floor(x/32) AS INT) AS cx, CAST(floor(y/32) AS INT) AS cy, CAST(floor(z/32) AS INT) AS cz FROM {voxels}) c""",
    "indexed_cov": """
SELECT cx, cy, cz, CASE status WHEN 'FAILED' THEN 'MISSING' ELSE status END AS status FROM {chunk_cov} WHERE NOT (cx % 3 = 2 AND cz = 0)""",
    "heights": """
SELECT x, z, max(y) AS rain_y, greatest(max(y) - 3, 0) AS terrain_y
FROM {voxels} WHERE NOT (x % 96 >= 64 AND z < 32) GROUP BY x, z""",
    "liquids": """
SELECT x, y, z, 18 AS liquid_id FROM {voxels}
WHERE (x + z) % 7 = 0 AND NOT (x < 32 AND z >= 64)""",
    "regions": """
SELECT DISTINCT CAST(c_nationkey - 12 AS INT) AS rx, CAST((c_custkey*7) % (40 * :scale) - 20 AS INT) AS rz
FROM {customer}""",
    "layer_cells": """
SELECT rx, rz, layer, lx, lz, max(raw) AS raw FROM (
 SELECT CAST(o_custkey % (4 * :scale) AS INT) AS rx, CAST(floor(o_custkey/4) % 4 AS INT) AS rz,
        CASE WHEN o_orderkey % 5 = 0 THEN CASE CAST(floor(o_orderkey/5) % 3 AS INT) WHEN 0 THEN 'ocean' WHEN 1 THEN 'landform' ELSE 'province' END
             WHEN o_orderstatus = 'O' THEN 'climate' WHEN o_orderstatus = 'F' THEN 'forest'
             ELSE 'ore:' || substr(o_orderpriority, 1, 1) END AS layer,
        CAST(o_orderkey % 18 AS INT) AS lx, CAST(floor(o_orderkey/18) % 18 AS INT) AS lz,
        CAST(CASE WHEN o_orderkey % 5 = 0 THEN CAST(floor(o_totalprice) AS BIGINT) % 23
             WHEN o_orderstatus = 'O' THEN CAST(floor(o_totalprice) AS BIGINT)*40 % 16777216
             ELSE CAST(floor(o_totalprice) AS BIGINT) % 256 END AS INT) AS raw
 FROM {orders}) l GROUP BY rx, rz, layer, lx, lz""",
    "requests": """
SELECT CAST(request_id + 2 * s AS INT) AS request_id, resource, mode, CAST(cx + 96 * s AS INT) AS cx, cz, radius, y_min, y_max
FROM (VALUES (1,'nativecopper','ORE_CODE',48,48,40,0,127),(1,'cassiterite','ORE_CODE',48,48,40,0,127),
 (2,'galena','ORE_CODE',10,80,24,16,95),(2,'absentium','ORE_CODE',10,80,24,16,95))
 AS t(request_id, resource, mode, cx, cz, radius, y_min, y_max), :strips""",
    "arrivals": """
SELECT event_id, ts, CAST(user_id % (3 * :scale) AS INT) AS cx, CAST(event_id % 4 AS INT) AS cy,
       CAST(floor(user_id/3) % 3 AS INT) AS cz,
       CASE event_type WHEN 'error' THEN 'FAILED' ELSE 'AVAILABLE' END AS status
FROM {events}""",
    "compat": """
SELECT * FROM (VALUES ('nativecopper','game:rock-granite','COMPATIBLE'),('nativecopper','game:rock-basalt','COMPATIBLE'),
 ('cassiterite','game:rock-granite','COMPATIBLE'),('galena','rock-limestone','INCOMPATIBLE'),('galena','game:rock-granite','INCOMPATIBLE'),
 ('galena','game:rock-basalt','INCOMPATIBLE'),('galena','game:rock-sandstone','INCOMPATIBLE')) AS t(resource, rock_code, verdict)""",
}


class World:
    """The views as DataFrames over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def scale(self) -> int:
        """Strips of the world, from the number of rows in lineitem's footers."""
        return max(1, self.table("lineitem").count() // STRIP_ROWS)

    @property
    def size(self) -> tuple[int, int, int]:
        return STRIP * self.scale, SIZE_Y, SIZE_Z

    def sql(self, text: str) -> DataFrame:
        """A query over the tables and views named in braces."""
        uses = {k: getattr(self, k) if k in VIEWS else self.table(k) for k in re.findall(r"\{(\w+)\}", text)}
        for token, value in ((":scale", str(self.scale)), (":strips", f"range(0, {self.scale}) AS strip(s)")):
            text = text.replace(token, value) if token in text else text
        return self.spark.sql(text, **uses)

    def _view(self, name: str) -> DataFrame:
        return self.sql(VIEWS[name])

    @property
    def tasks(self) -> int:
        """Tasks that voxels are dealt over, a number that grows with lineitem."""
        return max(self.spark.sparkContext.defaultParallelism, -(-self.scale * STRIP_ROWS // TASK_ROWS))

    def _dealt_voxels(self, *keys: str) -> DataFrame:
        """The view voxels, dealt out once by keys. What is grouped by more than the keys
        stays where it is."""
        tasks = self.tasks
        placed = G.with_chunks(self.sql(PLACED)).select(*dict.fromkeys([*keys, "x", "y", "z"]), "block_id").repartition(tasks, *keys)
        best = placed.groupBy(*dict.fromkeys([*keys, "x", "y", "z"])).agg(F.max("block_id").alias("block_id"))
        return best.select("x", "y", "z", "block_id")

    def voxels_by_column(self) -> DataFrame:
        """The voxels for what groups by column (x, z) and more, without reducing them."""
        return self.voxels.repartition(self.tasks, "x", "z") if "voxels" in self.__dict__ else self._dealt_voxels("x", "z")

    def keep_voxels(self) -> None:
        """Store the voxels, and what chunks there are, before the views that several
        branches of a query derive from them, as the voxels of a real world are a stored
        table. A chunk column's voxels lie in one file, so that what is counted or
        compared by column or chunk shrinks before it is shuffled."""
        if "voxels" not in self.__dict__:
            self.voxels = store(self._dealt_voxels("cx", "cz"), "voxels")[0]
            self.chunk_cov = store(self._view("chunk_cov"), "chunk_cov")[0]

    registry = cached_property(lambda self: self._view("registry"))
    voxels = cached_property(lambda self: self._view("voxels"))
    chunk_cov = cached_property(lambda self: self._view("chunk_cov"))
    indexed_cov = cached_property(lambda self: self._view("indexed_cov"))
    heights = cached_property(lambda self: self._view("heights"))
    liquids = cached_property(lambda self: self._view("liquids"))
    regions = cached_property(lambda self: self._view("regions"))
    layer_cells = cached_property(lambda self: self._view("layer_cells"))
    requests = cached_property(lambda self: self._view("requests"))
    arrivals = cached_property(lambda self: self._view("arrivals"))
    compat = cached_property(lambda self: self._view("compat"))


def for_oracle(text: str) -> str:
    """A view's or query's text for DuckDB."""
    text = text.replace(":strips", "(SELECT unnest(range(0, scale)) AS s FROM extent) strip").replace(":scale", SCALE_SQL)
    return re.sub(r"[{](\w+)[}]", r"\1", text)


def oracle(body: str) -> str:
    """DuckDB SQL: body over the views."""
    views = ",\n".join([EXTENT, *(f"{k} AS ({for_oracle(v)})" for k, v in VIEWS.items())])
    return f"WITH RECURSIVE {views}\nSELECT * FROM ({body})"
