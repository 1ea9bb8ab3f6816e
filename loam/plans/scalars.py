"""Queries of the coordinate and code functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import geometry as G
from ..operators.dims import small
from .base import Plans
from .worldviews import MAPCHUNKS_X, SIZE_Y, SIZE_Z, for_oracle

plans = Plans()
queries, oracle_sql = plans.queries, plans.oracle_sql

CIRCLES = "SELECT c_custkey, CAST(c_custkey % (96 * :scale) AS INT) AS cx, CAST(c_custkey * 3 % 96 AS INT) AS cz, CAST(c_custkey % 45 AS INT) AS radius, CAST(c_custkey % 50 AS INT) AS y_min, CAST(c_custkey % 50 + c_custkey % 70 AS INT) AS y_max FROM {customer}"
CIRCLES_SQL = for_oracle(CIRCLES)


def circles(w):
    return w.sql(CIRCLES)


@plans("g1_to_chunk", "SELECT l_orderkey, l_linenumber, CAST(floor(floor(l_extendedprice - 50000) / 32) AS INT) AS chunk FROM lineitem")
def g1(w):
    return w.table("lineitem").select("l_orderkey", "l_linenumber", G.to_chunk(F.col("l_extendedprice") - 50000).alias("chunk"))


@plans("g2_to_region", "SELECT c_custkey, CAST(floor((c_custkey * 13 % 2000 - 1000) / 16) AS INT) AS region FROM customer")
def g2(w):
    return w.table("customer").select("c_custkey", G.to_region(F.expr("c_custkey * 13 % 2000 - 1000")).alias("region"))


@plans("g3_local_index", "SELECT x, y, z, z % 32 * 32 + x % 32 AS column_index, (y % 32 * 32 + z % 32) * 32 + x % 32 AS voxel_index FROM voxels")
def g3(w):
    x, y, z = (F.col(c) for c in "xyz")
    return w.voxels.select("x", "y", "z", G.column_index(x, z).alias("column_index"), G.voxel_index(x, y, z).alias("voxel_index"))


@plans("g4_display_pos", "SELECT x, y, z, x - 48.0::DOUBLE * scale AS dx, z - 48.0::DOUBLE AS dz FROM voxels, extent")
def g4(w):
    return w.voxels.select("x", "y", "z", G.to_display(F.col("x"), w.size[0]).alias("dx"), G.to_display(F.col("z"), SIZE_Z).alias("dz"))


@plans("g5_in_circle", "SELECT request_id, resource, x, y, z FROM voxels, requests WHERE (x-cx)*(x-cx) + (z-cz)*(z-cz) <= radius*radius")
def g5(w):
    # requests meet the voxels of the mapchunks they touch
    areas = G.plan_mapchunks(w.requests, w.size[0], SIZE_Z)
    keyed = w.voxels.select("x", "y", "z", G.to_chunk(F.col("x")).alias("mx"), G.to_chunk(F.col("z")).alias("mz"))
    near = keyed.join(areas, ["mx", "mz"]).where(G.in_circle(F.col("x"), F.col("z"), F.col("cx"), F.col("cz"), F.col("radius")))
    return near.select("request_id", "resource", "x", "y", "z")


@plans("g6_circle_cells", f"""
SELECT c_custkey, count(*) AS cells, min(x) AS x0, max(x) AS x1, sum(x * 7 + z)::BIGINT AS checksum FROM (
  SELECT c.*, cx + i AS x, cz + j AS z FROM ({CIRCLES_SQL}) c, range(-44, 45) a(i), range(-44, 45) b(j)
  WHERE i * i + j * j <= radius * radius) GROUP BY c_custkey""")  # fmt: skip
def g6(w):
    cells = G.circle_cells(circles(w))
    return cells.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("cells"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.sum(F.col("x") * 7 + F.col("z")).alias("checksum"))


_TOUCH = "(cx - greatest(mx*32, least(cx, mx*32+31)))**2 + (cz - greatest(mz*32, least(cz, mz*32+31)))**2 <= radius*radius"


@plans("g7_plan_mapchunks", f"SELECT c_custkey, mx::INT AS mx, mz::INT AS mz FROM ({CIRCLES_SQL}) c, {MAPCHUNKS_X}, range(0, 3) b(mz) WHERE {_TOUCH}")
def g7(w):
    return G.plan_mapchunks(circles(w), w.size[0], SIZE_Z).select("c_custkey", "mx", "mz")


@plans("g8_plan_chunks", f"""
SELECT c_custkey, mx::INT AS mx, my::INT AS my, mz::INT AS mz FROM ({CIRCLES_SQL}) c, {MAPCHUNKS_X}, range(0, 3) b(mz), range(0, 4) d(my)
WHERE {_TOUCH} AND y_min <= least(y_max, 127) AND my BETWEEN y_min // 32 AND least(y_max, 127) // 32""")  # fmt: skip
def g8(w):
    return G.plan_chunks(circles(w), *w.size).select("c_custkey", "mx", "my", "mz")


@plans("g9_plan_window", f"""
SELECT c_custkey, mx::INT AS mx, mz::INT AS mz FROM ({CIRCLES_SQL}) c, {MAPCHUNKS_X}, range(0, 3) b(mz)
WHERE abs(mx - cx // 32) <= greatest(ceil(radius / 32), 1) AND abs(mz - cz // 32) <= greatest(ceil(radius / 32), 1)""")  # fmt: skip
def g9(w):
    return G.plan_window(circles(w), w.size[0], SIZE_Z).select("c_custkey", "mx", "mz")


@plans("g10_plan_full_height", "SELECT DISTINCT (x // 32)::INT AS mx, (z // 32)::INT AS mz, my::INT AS my FROM voxels, range(0, 4) r(my)")
def g10(w):
    chunks = w.voxels.select(G.to_chunk(F.col("x")).alias("mx"), G.to_chunk(F.col("z")).alias("mz")).distinct()
    return G.plan_full_height(chunks, SIZE_Y)


RECTS = "SELECT c_custkey, CAST(c_custkey % (96 * :scale + 54) - 30 AS INT) AS x0, CAST(c_custkey % (96 * :scale + 54) - 30 + c_custkey % 60 AS INT) AS x1, CAST(c_custkey * 3 % 150 - 30 AS INT) AS z0, CAST(c_custkey * 3 % 150 + 10 AS INT) AS z1 FROM {customer}"


@plans("g11_rect_clip", f"""
SELECT c_custkey, a AS x0, b AS x1, c AS z0, d AS z1, mx::INT AS mx, mz::INT AS mz FROM (
  SELECT c_custkey, greatest(x0, 0) AS a, least(x1, 96 * scale) AS b, greatest(z0, 0) AS c, least(z1, 96) AS d FROM ({for_oracle(RECTS)}), extent) r,
  {MAPCHUNKS_X}, range(0, 3) q(mz)
WHERE a < b AND c < d AND mx BETWEEN a // 32 AND (b - 1) // 32 AND mz BETWEEN c // 32 AND (d - 1) // 32""")  # fmt: skip
def g11(w):
    return G.rect_clip(w.sql(RECTS), w.size[0], SIZE_Z)


@plans("g12_to_tile", "SELECT rx, rz, CAST(floor(rx / 4) AS INT) AS tx, CAST(floor(rz / 4) AS INT) AS tz FROM regions")
def g12(w):
    return w.regions.select("rx", "rz", G.to_tile(F.col("rx"), 4).alias("tx"), G.to_tile(F.col("rz"), 4).alias("tz"))


@plans("g13_square_ring", """
SELECT k AS c_custkey, row_number() OVER (PARTITION BY k ORDER BY side, step) - 1 AS place, (tx + i)::INT AS rx, (tz + j)::INT AS rz FROM (
  SELECT c_custkey AS k, (c_custkey % 9 - 4)::INT AS tx, (c_custkey % 7 - 3)::INT AS tz, (c_custkey % 4)::INT AS d, i, j,
         CASE WHEN d = 0 THEN 0 WHEN j = -d THEN 1 WHEN i = d THEN 2 WHEN j = d THEN 3 ELSE 4 END AS side,
         CASE WHEN d = 0 THEN 0 WHEN j = -d THEN i WHEN i = d THEN j WHEN j = d THEN -i ELSE -j END AS step
  FROM customer, range(-3, 4) a(i), range(-3, 4) b(j) WHERE greatest(abs(i), abs(j)) = (c_custkey % 4))""")
def g13(w):
    centres = w.table("customer").selectExpr("c_custkey", "int(c_custkey % 9 - 4) AS tx", "int(c_custkey % 7 - 3) AS tz", "int(c_custkey % 4) AS d")
    return G.square_ring(centres).select("c_custkey", F.col("place").cast("long"), "rx", "rz")


@plans("g14_intmap_cells", """
SELECT rx, rz, layer, lx, lz, raw, rx*512 + (lx-1)*32.0::DOUBLE AS x0, rx*512 + lx*32.0::DOUBLE AS x1, rz*512 + (lz-1)*32.0::DOUBLE AS z0, rz*512 + lz*32.0::DOUBLE AS z1
FROM layer_cells WHERE lx BETWEEN 1 AND 16 AND lz BETWEEN 1 AND 16""")
def g14(w):
    return G.inner_cells(w.layer_cells)


BANDS = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS low, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size + 20 END AS high, CAST(p_partkey % 90 AS INT) AS y FROM {part}"


@plans("g15_y_filter", f"""
SELECT p_partkey, coalesce(y >= low, true) AND coalesce(y <= high, true) AS inside,
  CASE WHEN low IS NULL AND high IS NULL THEN 'all' WHEN low IS NULL THEN '<=' || high WHEN high IS NULL THEN '>=' || low ELSE low || '..' || high END AS text
FROM ({BANDS.replace('{part}', 'part')})""")  # fmt: skip
def g15(w):
    low, high = F.col("low"), F.col("high")
    return w.spark.sql(BANDS, part=w.table("part")).select("p_partkey", G.in_y_range(F.col("y"), low, high).alias("inside"), G.y_range_text(low, high).alias("text"))


@plans("g16_in_world", "SELECT o_orderkey, o_orderkey % (100 * scale + 100) - 50 AS x FROM orders, extent WHERE o_orderkey % (100 * scale + 100) - 50 BETWEEN 0 AND 96 * scale - 1")
def g16(w):
    return w.sql("SELECT o_orderkey, o_orderkey % (100 * :scale + 100) - 50 AS x FROM {orders}").where(G.in_world(F.col("x"), w.size[0]))


@plans("g17_nearest_lod", """
SELECT c_custkey, arg_min(lod, far ORDER BY lod)::INT AS lod FROM (
  SELECT c_custkey, lod, abs(ln((1 << lod)::DOUBLE / (1.0 / ((c_custkey % 64 + 1) / 8.0::DOUBLE))) / ln(2.0)) AS far FROM customer, range(0, 6) r(lod)) GROUP BY c_custkey""")
def g17(w):
    return w.table("customer").select("c_custkey", G.nearest_lod((F.col("c_custkey") % 64 + 1) / F.lit(8.0)).alias("lod"))


KEYS = "SELECT o_orderkey, CAST(o_orderkey % 2097152 - 1048576 AS INT) AS x, CAST(o_orderkey % 600 AS INT) AS y, CAST(o_custkey % 1000 - 500 AS INT) AS z, CAST(o_custkey % 1024 AS INT) AS dim FROM {orders}"


@plans("d1_positions", f"""
SELECT o_orderkey, key, x, y, z, dim FROM (SELECT *, (x::BIGINT & 2097151) | ((dim & 31)::BIGINT << 22) | ((z::BIGINT & 2097151) << 27)
  | ((dim >> 5)::BIGINT << 49) | (y::BIGINT << 54) AS key FROM ({KEYS.replace('{orders}', 'orders')}) WHERE y <= 511)""")  # fmt: skip
def d1(w):
    keys = w.spark.sql(KEYS, orders=w.table("orders"))
    packed = keys.select("o_orderkey", G.encode_position(*(F.col(c) for c in ("x", "y", "z", "dim"))).alias("key")).where("key IS NOT NULL")
    return packed.withColumn("p", G.decode_position(F.col("key"))).select("o_orderkey", "key", "p.x", "p.y", "p.z", "p.dim")


@plans("s16_revision_id", r"SELECT o_orderkey, sha256(o_orderkey || chr(10) || o_custkey || chr(10) || o_orderstatus || chr(10) || o_orderpriority) AS revision FROM orders")
def s16(w):
    from ..sources.raw import revision_id

    return w.table("orders").select("o_orderkey", revision_id("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").alias("revision"))


# -- codes: each block id that occurs, with its code and its number of voxels

CODED = "SELECT v.block_id, any_value(code) AS code, count(*) AS n FROM voxels v LEFT JOIN registry r ON v.block_id = r.block_id GROUP BY v.block_id"


def coded(w):
    return w.voxels.groupBy("block_id").agg(F.count(F.lit(1)).alias("n")).join(small(w.registry), "block_id", "left")


def _of(name, sql, **columns):
    """A query of one classifier over the coded blocks."""

    @plans(name, f"SELECT block_id, n, {sql} FROM ({CODED})")
    def run(w):
        return coded(w).select("block_id", "n", *[f().alias(k) for k, f in columns.items()])


_SOIL_TIERS = "CASE {} WHEN 'verylow' THEN 'BARREN' WHEN 'low' THEN 'LOW' WHEN 'medium' THEN 'MEDIUM' WHEN 'high' THEN 'HIGH' WHEN 'compost' THEN 'TERRA_PRETA' END"
_FOLIAGE_SQL = "|".join(C.FOLIAGE)

_of("c1_is_air", "block_id = 0 OR coalesce(code, '') IN ('air', 'game:air') OR coalesce(code, '') LIKE '%:air' AS air", air=lambda: C.is_air(F.col("block_id"), F.col("code")))
_of("c2_is_foliage", f"block_id <> 0 AND regexp_matches(coalesce(code, ''), '{_FOLIAGE_SQL}') AS foliage", foliage=lambda: C.is_foliage(F.col("block_id"), F.col("code")))
_of("c3_is_ore", "regexp_matches(coalesce(code, ''), '^([^:]*:)?ore-') AS ore", ore=lambda: C.is_ore(F.col("code")))
_of(
    "c4_match_ore", "regexp_matches(coalesce(code, ''), '^([^:]*:)?ore-.*nativecopper') AS copper, regexp_matches(coalesce(code, ''), '^([^:]*:)?ore-.*galena') AS galena",
    copper=lambda: C.match_ore(F.col("code"), F.lit(" NativeCopper ")), galena=lambda: C.match_ore(F.col("code"), F.lit("galena")),
)
_of(
    "c5_match_block", "regexp_matches(coalesce(code, ''), '^([^:]*:)?ore-.*granite') AS by_ore, contains(coalesce(code, ''), 'granite') AS by_text",
    by_ore=lambda: C.match_block(F.col("code"), F.lit("granite"), F.lit("ORE_CODE")), by_text=lambda: C.match_block(F.col("code"), F.lit("granite"), F.lit("GENERIC_SUBSTRING")),
)

SURFACE_SQL = f"""CASE WHEN contains(coalesce(lcode, ''), 'water') AND lid <> 0 THEN 'WATER' WHEN code IS NULL OR block_id = 0 THEN 'UNKNOWN'
  WHEN contains(code, 'water') THEN 'WATER' WHEN contains(code, 'snow') THEN 'SNOW' WHEN contains(code, 'forestfloor') THEN 'FOREST_FLOOR'
  WHEN regexp_matches(code, '{_FOLIAGE_SQL}') THEN 'VEGETATION' WHEN contains(code, 'grass') THEN 'GRASS'
  WHEN regexp_matches(code, '{"|".join(C.ROCK_LIKE)}') THEN 'ROCK' WHEN contains(code, 'gravel') THEN 'GRAVEL' WHEN contains(code, 'sand') THEN 'SAND'
  WHEN regexp_matches(code, '{"|".join(C.SOIL_LIKE)}') THEN 'SOIL' ELSE 'UNKNOWN' END"""
SURFACE_CODE_SQL = "CASE class WHEN 'WATER' THEN 0 WHEN 'GRASS' THEN 1 WHEN 'FOREST_FLOOR' THEN 2 WHEN 'SOIL' THEN 3 WHEN 'ROCK' THEN 4 WHEN 'SAND' THEN 5 WHEN 'GRAVEL' THEN 6 WHEN 'VEGETATION' THEN 7 WHEN 'SNOW' THEN 8 ELSE 9 END"

_of(
    "c6_surface_class", SURFACE_SQL.replace("lcode", "NULL").replace("lid", "0") + " AS dry, " + SURFACE_SQL.replace("lcode", "'game:water-still-7'").replace("lid", "18") + " AS wet",
    dry=lambda: C.surface_class(F.col("block_id"), F.col("code"), F.lit(0), F.lit(None).cast("string")),
    wet=lambda: C.surface_class(F.col("block_id"), F.col("code"), F.lit(18), F.lit("game:water-still-7")),
)
_of("c7_rock_identity", r"CASE WHEN regexp_matches(code, '^([\p{L}\p{Nd}_.-]+:)?rock-[\p{L}\p{Nd}_.-]+$') THEN code END AS rock", rock=lambda: C.rock_code(F.col("code")))

SOIL_SQL = """CASE WHEN regexp_matches(p, '^bonysoil(-[1-7])?$') THEN 'BONY' WHEN regexp_matches(p, '^forestfloor-[0-7]$') THEN 'LOW'
  WHEN regexp_matches(p, '^soil-(verylow|low|medium|high|compost)-(none|verysparse|sparse|normal)$') THEN """ + _SOIL_TIERS.format("split_part(p, '-', 2)") + """
  WHEN regexp_matches(p, '^farmland-(dry|moist)-(verylow|low|medium|high|compost)$') THEN """ + _SOIL_TIERS.format("split_part(p, '-', 3)") + " END"  # fmt: skip
PATH_SQL = "CASE WHEN regexp_matches(code, '^(game:)?[^:]+$') THEN replace(code, 'game:', '') END"


@plans("c8_soil_fertility", f"""
SELECT block_id, n, {SOIL_SQL} AS tier, CASE {SOIL_SQL} WHEN 'BONY' THEN 0 WHEN 'BARREN' THEN 5 WHEN 'LOW' THEN 25 WHEN 'MEDIUM' THEN 50 WHEN 'HIGH' THEN 65 WHEN 'TERRA_PRETA' THEN 80 END AS percent,
  CASE WHEN {SOIL_SQL} IS NOT NULL THEN CASE split_part(p, '-', 1) WHEN 'bonysoil' THEN 'BONY_SOIL' WHEN 'forestfloor' THEN 'FOREST_FLOOR' WHEN 'soil' THEN 'SOIL' ELSE 'FARMLAND' END END AS source
FROM (SELECT *, {PATH_SQL} AS p FROM ({CODED}))""")  # fmt: skip
def c8(w):
    return coded(w).withColumn("f", C.soil_fertility(F.col("code"))).select("block_id", "n", "f.tier", "f.percent", "f.source")


OBJECT_SQL = f"""
SELECT block_id, n, code, CASE split_part(p, '-', 1) WHEN 'looseores' THEN 'ORE_BITS' WHEN 'looseflints' THEN 'FLINT' WHEN 'loosestones' THEN 'LOOSE_STONE' ELSE 'LOOSE_BOULDER' END AS family,
  split_part(p, '-', 2) AS key, CASE WHEN p LIKE 'looseores-%' THEN split_part(p, '-', 3) END AS host_rock, split_part(p, '-', -1) AS variant, ns AS namespace
FROM (SELECT *, regexp_replace(code, '^[^:]*:', '') AS p, CASE WHEN contains(code, ':') THEN split_part(code, ':', 1) ELSE '' END AS ns FROM ({CODED}))
WHERE regexp_matches(p, '^loose(ores-[a-z]+-[a-z]+|(flints|stones|boulders)-[a-z]+)-(free|snow|water|ice)$')"""


@plans("c9_object_identity", f"SELECT block_id, n, family, key, host_rock, variant, namespace FROM ({OBJECT_SQL})")
def c9(w):
    return coded(w).withColumn("o", C.object_identity(F.col("code"))).where("o IS NOT NULL").select("block_id", "n", "o.family", "o.key", "o.host_rock", "o.variant", "o.namespace")


@plans("c10_object_display", f"""
SELECT block_id, n, upper(key[1]) || key[2:] || CASE WHEN namespace IN ('', 'game') THEN '' ELSE ' [' || namespace || ']' END AS display,
  CASE family WHEN 'ORE_BITS' THEN 'Ore bits' WHEN 'FLINT' THEN 'Flint' WHEN 'LOOSE_STONE' THEN 'Loose stone' ELSE 'Loose boulder' END AS label FROM ({OBJECT_SQL})""")  # fmt: skip
def c10(w):
    named = coded(w).withColumn("o", C.object_identity(F.col("code"))).where("o IS NOT NULL")
    return named.select("block_id", "n", C.object_display(F.col("o.key"), F.col("o.namespace")).alias("display"), C.family_labels(F.array("o.family")).alias("label"))


_of(
    "c11_material_match", "contains(coalesce(code, ''), 'fire') AND contains(coalesce(code, ''), 'clay') AS fire_clay, contains(coalesce(code, ''), 'clay') AS clay, contains(coalesce(code, ''), 'peat') AS peat",
    **{k: (lambda name: lambda: C.material_match(F.col("code"), C.preset_tokens(F.lit(name))))(v) for k, v in {"fire_clay": "Fire Clay", "clay": "clay", "peat": " peat "}.items()},
)


@plans("c12_match_keys", """
SELECT query, key, n FROM (
  SELECT query, key, n, key = query OR split_part(key, ':', 2) = query AS ex, max(CASE WHEN key = query OR split_part(key, ':', 2) = query THEN 1 ELSE 0 END) OVER (PARTITION BY query) AS any_ex
  FROM (SELECT layer AS key, count(*) AS n FROM layer_cells GROUP BY layer), (SELECT DISTINCT lower(substr(o_orderpriority, 1, 1)) AS query FROM orders UNION SELECT 'ore' UNION SELECT 'forest'))
WHERE ex OR (any_ex = 0 AND contains(key, query))""")
def c12(w):
    keys = w.layer_cells.groupBy(F.col("layer").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    asked = w.table("orders").selectExpr("lower(substr(o_orderpriority, 1, 1)) AS query").union(w.spark.sql("SELECT explode(array('ore', 'forest'))")).distinct()
    return C.match_keys(keys.select("key"), asked).join(keys, "key").select("query", "key", "n")


NAMED = "SELECT DISTINCT code FROM {voxels} v JOIN {registry} r ON v.block_id = r.block_id"
SIGNALS = "SELECT explode(array('copper', 'game:nativecopper', 'mod:galena', 'cassiterite', 'rich_galena-x', 'absentium', ' ')) AS key"


@plans("c13_ore_directory", f"""
SELECT m.match, display, source_key, count(DISTINCT CASE WHEN regexp_matches(code, '^([^:]*:)?ore-') AND contains(code, m.match) THEN code END) AS n_codes
FROM (VALUES ('nativecopper', 'Native Copper', 'copper'), ('galena', 'Galena', 'mod:galena'), ('cassiterite', 'Tin / Cassiterite', 'cassiterite'), ('rich_galena-x', 'Rich Galena X', 'rich_galena-x'), ('absentium', 'Absentium', 'absentium')) m(match, display, source_key),
  ({NAMED.replace('{', '').replace('}', '')}) c GROUP BY ALL""")  # fmt: skip
def c13(w):
    return C.ore_directory(w.spark.sql(SIGNALS), w.spark.sql(NAMED, voxels=w.voxels, registry=w.registry))


@plans("c14_object_search", f"SELECT block_id, n, key FROM ({OBJECT_SQL}) WHERE contains(key, 'granite') AND family IN ('FLINT', 'LOOSE_STONE')")
def c14(w):
    from ..operators.objects import search

    named = coded(w).withColumn("o", C.object_identity(F.col("code"))).where("o IS NOT NULL")
    named = named.select("block_id", "n", "o.key", C.object_display(F.col("o.key"), F.col("o.namespace")).alias("display"), F.array("o.family").alias("families"))
    return search(named, "  Granite ", ["FLINT", "LOOSE_STONE"]).select("block_id", "n", "key")


@plans("c15_climate_bits", "SELECT rx, rz, lx, lz, (raw >> 16) & 255 AS temperature, (raw >> 8) & 255 AS rain FROM layer_cells WHERE layer = 'climate'")
def c15(w):
    t, r = C.climate_bits(F.col("raw"))
    return w.layer_cells.where("layer = 'climate'").select("rx", "rz", "lx", "lz", t.alias("temperature"), r.alias("rain"))


FOREST_SQL = "CASE WHEN {0} <= 0 THEN 'NONE' WHEN {0} < 0.2 THEN 'SPARSE' WHEN {0} < 0.4 THEN 'LIGHT' WHEN {0} < 0.6 THEN 'MODERATE' WHEN {0} < 0.8 THEN 'DENSE' ELSE 'VERY_DENSE' END"


@plans("c16_forest_density", f"SELECT rx, rz, lx, lz, raw / 255.0::DOUBLE AS density, {FOREST_SQL.format('(raw / 255.0::DOUBLE)')} AS class FROM layer_cells WHERE layer = 'forest'")
def c16(w):
    d = C.forest_density(F.col("raw"))
    return w.layer_cells.where("layer = 'forest'").select("rx", "rz", "lx", "lz", d.alias("density"), C.forest_class(d).alias("class"))


LABELS_SQL = "list_filter([CASE WHEN t <= 85 THEN 'COLD' END, CASE WHEN t >= 170 THEN 'HOT' END, CASE WHEN r <= 85 THEN 'ARID' END, CASE WHEN r >= 170 THEN 'HUMID' END, CASE WHEN d <= 0.2::DOUBLE THEN 'OPEN' END, CASE WHEN d >= 0.6::DOUBLE THEN 'FORESTED' END], lambda v: v IS NOT NULL)"


@plans("c17_environment_labels", f"""
SELECT lx, lz, array_to_string({LABELS_SQL}, ',') AS labels FROM (
  SELECT lx, lz, avg(CASE WHEN layer = 'climate' THEN (raw >> 16) & 255 END) AS t, avg(CASE WHEN layer = 'climate' THEN (raw >> 8) & 255 END) AS r,
         avg(CASE WHEN layer = 'forest' THEN raw END) / 255.0::DOUBLE AS d FROM layer_cells GROUP BY lx, lz)""")  # fmt: skip
def c17(w):
    t, r = C.climate_bits(F.col("raw"))
    climate = F.col("layer") == "climate"
    means = w.layer_cells.groupBy("lx", "lz").agg(
        F.avg(F.when(climate, t)).alias("t"), F.avg(F.when(climate, r)).alias("r"), C.mean_density(F.when(F.col("layer") == "forest", F.col("raw"))).alias("d"))
    return means.select("lx", "lz", F.array_join(C.environment_labels(F.col("t"), F.col("r"), F.col("d")), ",").alias("labels"))
