"""Queries of decode jobs, stored tables, tiles and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import codes as C
from ..functions import colours as P
from ..functions import geometry as G
from ..operators import graph, ore, regions, rock, surface, tiles
from ..operators.dims import large
from ..operators.graph import store
from ..operators.tables import stored_columns, stored_legend, stored_pixels
from ..sources import bucketed, decode, encode, published, savefile
from ..sources import payloads as Payload
from ..sources import tables as T
from .base import Plans
from .scalars import LABELS_SQL
from .worlds import CELLS, PROFILES, SOILMAP, SURFACE, inner, no_liquids, resolved, rock_sql, upper, world_header
from .worldviews import SIZE_Y, SIZE_Z, for_oracle

plans = Plans()
queries, oracle_sql = plans.queries, plans.oracle_sql


def scratch(w, name):
    return graph.scratch(w.spark, name)


# -- raw scans: keys and payloads derived from orders, some of them broken

RAW = "SELECT o_orderkey AS id, CAST(o_orderkey % 40 AS INT) AS px, CAST(o_custkey % 40 AS INT) AS pz, CAST(CASE WHEN o_orderkey % 11 = 0 THEN 3 ELSE 0 END AS INT) AS py, CAST(CASE WHEN o_orderkey % 13 = 0 THEN 2 ELSE 0 END AS INT) AS pd, o_orderkey % 7 = 0 AS bad, o_orderkey % 5 = 0 AS hollow FROM {orders}"
RAW_SQL = RAW.replace("{orders}", "orders")
STATUS_SQL = "CASE WHEN bad THEN 'INVALID' WHEN pd <> 0 {0} THEN 'IGNORED' WHEN hollow THEN 'INVALID' ELSE 'READ' END"


def raw(w):
    rows = w.spark.sql(RAW, orders=w.table("orders"))
    key = G.encode_position(F.col("px"), F.col("py"), F.col("pz"), F.col("pd"))
    whole = Payload.put_chunk(np.zeros(Payload.CELLS, np.int32))
    payload = F.when(F.col("hollow"), F.lit(b"")).when(F.expr("id % 97 = 0"), F.lit(whole)).when(F.expr("id % 97 = 1"), F.lit(whole + Payload.put(16, b"\1\0\0\0x"))).otherwise(F.lit(b"\x08\x01"))
    rows = rows.select("id", F.when(F.col("bad"), key.bitwiseOR(F.lit(1 << 21))).otherwise(key).alias("position"), payload.alias("data"))
    return store(rows, "raw")[0]  # raw tables are stored ones; keys are decoded from a column


@plans("s1_scan_mapregions", f"SELECT {STATUS_SQL.format('OR py <> 0')} AS status, count(*) AS n FROM ({RAW_SQL}) GROUP BY 1")
def s1(w):
    return decode.scan_raw(raw(w), vertical=False).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@plans("s2_scan_mapchunks", f"SELECT id, px AS x, pz AS z FROM ({RAW_SQL}) WHERE {STATUS_SQL.format('OR py <> 0')} = 'READ' AND px < 3 AND pz < 3")
def s2(w):
    read = decode.scan_raw(raw(w), vertical=False).where("status = 'READ'")
    return read.where(G.in_world(F.col("x"), 3) & G.in_world(F.col("z"), 3)).select("id", "x", "z")


SCANNED = f"scanned AS (SELECT id, {STATUS_SQL.format('')} AS status, id % 97 AS kind FROM ({RAW_SQL}))"
LIQUID_ERROR = "palette: zstd decompressor error: Unknown frame descriptor"


@plans("d10_read_diagnostics", f"""
WITH {SCANNED}, wet AS (SELECT * FROM scanned WHERE status = 'READ' AND kind = 1)
SELECT 'PARSED' AS kind, NULL::VARCHAR AS reason, count(*) AS n FROM scanned WHERE status = 'READ' AND kind IN (0, 1)
UNION ALL SELECT CASE WHEN status = 'IGNORED' THEN 'SKIPPED' ELSE 'FAILED' END AS k, CASE WHEN status = 'READ' THEN 'unsupported version None' ELSE 'unspecified' END AS r, count(*) FROM scanned WHERE NOT (status = 'READ' AND kind IN (0, 1)) GROUP BY ALL
UNION ALL SELECT 'LIQUID', NULL, count(*) FROM wet
UNION ALL SELECT 'LIQUID_SAMPLE', 'liquid decode failed: {LIQUID_ERROR}', 1 FROM (SELECT id FROM wet ORDER BY id LIMIT 10)""")
def d10(w):
    scanned = decode.scan_raw(raw(w), vertical=True)
    read = decode.decode_chunk(scanned.where("status = 'READ'").select("id", "status", "data")).select("id", "status", "error", "liquid_error")
    unread = scanned.where("status <> 'READ'").select("id", "status")
    return decode.read_diagnostics(read.unionByName(unread, allowMissingColumns=True))


# -- decode round trips


@plans("d2_decode_heights", "SELECT x // 32 AS mx, z // 32 AS mz, sum(rain_y)::BIGINT AS rain, sum(terrain_y)::BIGINT AS terrain, max(rain_y * 1000 + x % 32 + z % 32) AS top FROM heights GROUP BY ALL")
def d2(w):
    h = decode.decode_heights(encode.raw_mapchunks(w.heights).select("mx", "mz", "data")).where("error IS NULL")
    cells = h.select("mx", "mz", F.posexplode(F.arrays_zip("rain", "terrain")).alias("i", "v"))
    top = F.max(F.when(F.col("v.rain") > 0, F.col("v.rain") * 1000 + F.col("i") % 32 + F.floor(F.col("i") / 32).cast("int")))
    return cells.groupBy("mx", "mz").agg(F.sum("v.rain").alias("rain"), F.sum("v.terrain").alias("terrain"), top.alias("top"))


@plans("d3_decode_region", "SELECT rx, rz, layer, lx, lz, raw, 18 AS size, 1 AS pad_low, 1 AS pad_high FROM layer_cells WHERE raw <> 0")
def d3(w):
    return decode.map_cells(decode.decode_region(encode.raw_regions(w.layer_cells).select("rx", "rz", "data"))).where("raw <> 0")


@plans("d4_decode_intmap", "SELECT rx, rz, 18 AS size, 1 AS pad_low, 324::INT AS cells, sum(raw)::BIGINT AS total FROM layer_cells WHERE layer = 'forest' GROUP BY rx, rz")
def d4(w):
    r = decode.decode_region(encode.raw_regions(w.layer_cells.where("layer = 'forest'")).select("rx", "rz", "data"))
    total = F.aggregate("forest.data", F.lit(0).cast("long"), lambda a, x: a + x)
    return r.select("rx", "rz", "forest.size", "forest.pad_low", F.size("forest.data").alias("cells"), total.alias("total"))


@plans("d5_decode_chunk", "SELECT x, y, z, block_id FROM voxels WHERE block_id <> 0")
def d5(w):
    return decode.chunk_voxels(decode.decode_chunk(encode.raw_chunks(w.voxels).select("cx", "cy", "cz", "data")))


@plans("d6_decode_layer", "SELECT x // 32 AS cx, y // 32 AS cy, z // 32 AS cz, sum(block_id::BIGINT * ((y % 32 * 32 + z % 32) * 32 + x % 32))::BIGINT AS checksum FROM voxels GROUP BY ALL")
def d6(w):
    chunks = decode.decode_chunk(encode.raw_chunks(w.voxels).select("cx", "cy", "cz", "data"))
    terms = F.transform("blocks", lambda v, i: v.cast("long") * i)
    return chunks.select("cx", "cy", "cz", F.aggregate(terms, F.lit(0).cast("long"), lambda a, x: a + x).alias("checksum"))


@plans("d7_decode_palette", "SELECT cx, cy, cz, array_to_string(list_sort(list_distinct(list_append(list(DISTINCT block_id), 0))), ',') AS palette FROM (SELECT x // 32 AS cx, y // 32 AS cy, z // 32 AS cz, block_id FROM voxels) GROUP BY cx, cy, cz")
def d7(w):
    p = decode.decode_palette(encode.raw_chunks(w.voxels).select("cx", "cy", "cz", "data"))
    return p.select("cx", "cy", "cz", F.array_join(F.col("palette").cast("array<string>"), ",").alias("palette"))


@plans("d8_decode_registry", "SELECT r.block_id, code, count(*) AS n FROM registry r JOIN voxels v ON r.block_id = v.block_id GROUP BY ALL")
def d8(w):
    decoded = decode.decode_registry(encode.raw_registry(w.registry))
    return decoded.join(w.voxels.groupBy("block_id").agg(F.count(F.lit(1)).alias("n")), "block_id")


@plans("d9_decode_world_meta", "SELECT 96 * scale AS size_x, 128 AS size_y, 96 AS size_z, count(*) AS inside FROM voxels, extent GROUP BY scale")
def d9(w):
    meta = decode.decode_world_meta(encode.raw_registry(w.registry, w.size)).where("error IS NULL").drop("error")
    inside = w.voxels.join(F.broadcast(meta)).where("x < size_x AND y < size_y AND z < size_z")  # one row
    return inside.groupBy("size_x", "size_y", "size_z").agg(F.count(F.lit(1)).alias("inside"))


def broken_mapchunks(w):
    """Raw mapchunks of the heights; the one at (1, 1) of each strip is cut short."""
    rows = encode.raw_mapchunks(w.heights)
    return rows.withColumn("data", F.when((F.col("mx") % 3 == 1) & (F.col("mz") == 1), F.expr("substring(data, 1, 50)")).otherwise(F.col("data"))).select("position", "data")


@plans("s4_lookup_mapchunks", "SELECT x // 32 AS mx, z // 32 AS mz, count(*) AS columns FROM heights WHERE x // 32 % 3 = z // 32 GROUP BY ALL")
def s4(w):
    wanted = w.voxels.select(G.to_chunk(F.col("x")).alias("mx")).distinct().withColumn("mz", F.col("mx") % 3)
    keys = wanted.select(G.encode_position(F.col("mx"), F.lit(0), F.col("mz"), F.lit(0)).alias("position"))
    found = encode.raw_mapchunks(w.heights).select("position", "data").join(keys, "position", "left_semi")
    h = decode.decode_heights(found).withColumn("p", G.decode_position(F.col("position")))
    cells = h.select("p.x", "p.z", F.posexplode("rain").alias("i", "v"))
    stored = w.heights.select(G.to_chunk(F.col("x")).alias("mx"), G.to_chunk(F.col("z")).alias("mz"), G.column_index(F.col("x"), F.col("z")).alias("i"), "rain_y")
    same = cells.join(stored, (F.col("x") == F.col("mx")) & (cells["z"] == F.col("mz")) & (cells["i"] == stored["i"]) & (F.col("v") == F.col("rain_y")))
    return same.groupBy("mx", "mz").agg(F.count(F.lit(1)).alias("columns"))


@plans("s5_lookup_mapchunks_status", """
SELECT mx::INT AS mx, mz::INT AS mz, CASE WHEN (mx, mz) NOT IN (SELECT (x // 32, z // 32) FROM heights) THEN 'ABSENT' WHEN mx % 3 = 1 AND mz = 1 THEN 'PRESENT_UNREADABLE' ELSE 'PRESENT_DECODED' END AS read_status FROM (SELECT unnest(range(0, 3 * scale + 1)) AS mx FROM extent) a, range(0, 3) b(mz)""")
def s5(w):
    asked = w.spark.range(3 * w.scale + 1).select(F.col("id").cast("int").alias("mx"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("mz"))
    return decode.mapchunk_status(asked, broken_mapchunks(w)).select("mx", "mz", "read_status")


# -- stored tables


@plans("s10_write_terrain", "SELECT x, z, rain_y, terrain_y, 0 AS rx, 0 AS rz FROM heights")
def s10(w):
    path = scratch(w, "terrain")
    T.write_terrain(w.heights, path)
    T.write_terrain(w.heights, path)  # the same rows replace themselves
    return w.spark.read.parquet(path).select("x", "z", "rain_y", "terrain_y", "rx", "rz")


def mapchunks(w):
    return w.voxels.select(G.to_chunk(F.col("x")).alias("mx"), G.to_chunk(F.col("z")).alias("mz")).distinct()


TILES = "tiles AS (SELECT mx * 32 + i AS x, mz * 32 + j AS z FROM (SELECT DISTINCT x // 32 AS mx, z // 32 AS mz FROM voxels) m, range(0, 32) a(i), range(0, 32) b(j))"


@plans("s11_write_surface", f"WITH {SURFACE}, {TILES} SELECT t.x::INT AS x, t.z::INT AS z, class FROM tiles t LEFT JOIN surf s ON s.x = t.x AND s.z = t.z")
def s11(w):
    path = scratch(w, "surface")
    T.write_surface(T.surface_tiles(resolved(w), mapchunks(w)), path)
    return w.spark.read.parquet(path).select("x", "z", "class")


@plans("s12_write_upper_rock", f"WITH {rock_sql(0, 127)} SELECT x, z, state, rock_code FROM rock")
def s12(w):
    path = scratch(w, "rock")
    T.write_upper_rock(upper(w), path)
    return w.spark.read.parquet(path).select("x", "z", "state", "rock_code")


@plans("s13_write_region_profiles", f"WITH {PROFILES} SELECT rx, rz, array_to_string({LABELS_SQL}, ',') AS labels, true AS complete FROM prof")
def s13(w):
    path = scratch(w, "profiles")
    T.write_region_profiles(regions.environment_profiles(inner(w)), path)
    rows = w.spark.read.parquet(f"{path}/profiles").join(F.broadcast(w.spark.read.parquet(f"{path}/layer_status")))  # one status row
    return rows.select("rx", "rz", F.array_join("labels", ",").alias("labels"), "complete")


OCCURRENCES = "SELECT x // 32 AS cx, y // 32 AS cy, z // 32 AS cz, block_id, x % 32 AS lx, z % 32 AS lz, bit_or(1::BIGINT << (y % 32)) AS y_mask FROM voxels GROUP BY ALL"


@plans("s14_write_resource_index", f"SELECT o.* FROM ({OCCURRENCES}) o JOIN chunk_cov c ON c.cx = o.cx AND c.cy = o.cy AND c.cz = o.cz WHERE status = 'AVAILABLE'")
def s14(w):
    w.keep_voxels()
    path, masks = scratch(w, "index"), ore.y_masks(w.voxels_by_column())
    for part in ("cx % 2 = 0", "cx % 2 = 1", "cy = 1"):  # three publications, the last of chunks that are stored
        T.write_resource_index(masks, w.chunk_cov.where(part), path)
    return published.read(w.spark, path, T.OCCURRENCES, masks.schema).drop("rx", "rz")


@plans("s15_write_catalog", "SELECT DISTINCT cx, cy, cz FROM arrivals")
def s15(w):
    path, keys = scratch(w, "catalog"), ["cx", "cy", "cz"]
    T.write_catalog(w.arrivals.where("event_id % 3 = 0"), path, keys)
    T.write_catalog(w.arrivals, path, keys, complete=True)
    return w.spark.read.parquet(f"{path}/keys")


LAYERS = ("header", "terrain", "surface", "regions", "upper_rock", "resources")


@plans("p12_prepare_tables", """
SELECT run::INT AS run, layer, CASE run WHEN 1 THEN added ELSE 0 END AS added, true AS complete FROM range(1, 3) r(run), (
  SELECT 'header' AS layer, 1 AS added UNION ALL SELECT 'terrain', count(*) FROM heights UNION ALL SELECT 'surface', count(DISTINCT (x // 32, z // 32)) * 1024 FROM voxels
  UNION ALL SELECT 'regions', count(DISTINCT (rx, rz)) FROM layer_cells WHERE layer NOT LIKE 'ore:%' AND lx BETWEEN 1 AND 16 AND lz BETWEEN 1 AND 16
  UNION ALL SELECT 'upper_rock', count(DISTINCT (x, z)) FROM voxels
  UNION ALL SELECT 'resources', count(DISTINCT (x, z, y // 32, block_id)) FROM voxels v JOIN chunk_cov c ON cx = x // 32 AND cy = y // 32 AND cz = z // 32 WHERE status = 'AVAILABLE')""")
def p12(w):
    w.keep_voxels()
    path, chunk = scratch(w, "prepared"), ["cx", "cy", "cz"]
    profiles = regions.environment_profiles(inner(w))
    wanted = {
        "header": w.spark.range(1).select(F.lit(0).alias("world")), "terrain": w.heights.select("x", "z"), "surface": mapchunks(w), "regions": profiles.select("rx", "rz"),
        "upper_rock": w.voxels.select("x", "z").distinct(), "resources": w.chunk_cov.where("status = 'AVAILABLE'").select(*chunk)}
    keys = {"header": ["world"], "terrain": ["x", "z"], "surface": ["mx", "mz"], "regions": ["rx", "rz"], "upper_rock": ["x", "z"], "resources": chunk}
    tile = {"mx": G.to_chunk(F.col("x")), "mz": G.to_chunk(F.col("z"))}
    build = {
        "header": lambda todo: todo.join(F.broadcast(world_header(w))),  # one row each
        "terrain": lambda todo: w.heights.join(large(todo), ["x", "z"], "left_semi"),
        "surface": lambda todo: T.surface_tiles(resolved(w), todo).withColumns(tile),
        "regions": lambda todo: profiles.join(todo, ["rx", "rz"], "left_semi"),
        "upper_rock": lambda todo: rock.upper_rock(w.voxels, w.registry, w.chunk_cov, todo, 0, SIZE_Y - 1),
        "resources": lambda todo: ore.y_masks(w.voxels_by_column()).join(todo, chunk, "left_semi"),
    }
    runs = []
    for run in (1, 2):
        added = T.prepare(wanted, build, path, keys)
        counts = w.spark.createDataFrame([(layer, n) for layer, n in added.items()], "layer string, added long")
        # as the status stands after this run; the next one writes it anew
        runs.append(store(T.prepared(w.spark, path, LAYERS).join(counts, "layer").select(F.lit(run).alias("run"), "layer", "added", "complete"), "run")[0])
    return runs[0].unionByName(runs[1])


@plans("p14_load_tile", """
WITH m AS (SELECT (3 * s + i)::INT AS mx, mz::INT AS mz FROM (SELECT unnest(range(0, scale)) AS s FROM extent) strip, range(20 // 32, 89 // 32 + 1) a(i), range(0, 69 // 32 + 1) b(mz)),
  h AS (SELECT x // 32 AS mx, z // 32 AS mz, count(*) AS n FROM heights GROUP BY ALL),
  one AS (SELECT 1 AS pass, m.mx, m.mz, CASE WHEN n IS NULL THEN 'ABSENT' WHEN (m.mx + m.mz) % 2 = 1 THEN 'STORED' WHEN m.mx % 3 = 1 AND m.mz = 1 THEN 'PRESENT_UNREADABLE' ELSE 'PRESENT_DECODED' END AS source, n FROM m LEFT JOIN h ON h.mx = m.mx AND h.mz = m.mz),
  both_ AS (SELECT pass, mx, mz, source, CASE source WHEN 'STORED' THEN n WHEN 'PRESENT_DECODED' THEN 1024 ELSE 0 END AS heights FROM one
    UNION ALL SELECT 2, mx, mz, CASE source WHEN 'PRESENT_DECODED' THEN 'STORED' ELSE source END, CASE source WHEN 'STORED' THEN n WHEN 'PRESENT_DECODED' THEN 1024 ELSE 0 END FROM one)
SELECT pass, mx, mz, source, heights, CASE WHEN mx % 3 = 2 OR (mx, mz) NOT IN (SELECT (x // 32, z // 32) FROM voxels) THEN 0 ELSE 1024 END::BIGINT AS surface, min(heights) OVER (PARTITION BY pass) > 0 AS terrain_complete, false AS surface_complete FROM both_""")
def p14(w):
    w.keep_voxels()
    w.heights = store(w.heights, "heights")[0]  # read for the terrain, the surface and the raw payloads
    raw_ = store(broken_mapchunks(w), "raw")[0]
    terrain, surf, at = scratch(w, "terrain"), scratch(w, "surface"), {"mx": G.to_chunk(F.col("x")), "mz": G.to_chunk(F.col("z"))}
    T.write_terrain(w.heights.withColumns(at).where("(mx + mz) % 2 = 1").select("x", "z", "rain_y", "terrain_y"), terrain)
    T.write_surface(T.surface_tiles(resolved(w), mapchunks(w).where("mx % 3 <> 2")), surf)
    rects = w.sql("SELECT CAST(96 * s + 20 AS INT) AS x0, CAST(96 * s + 90 AS INT) AS x1, -5 AS z0, 70 AS z1 FROM :strips")
    asked = G.rect_clip(rects, w.size[0], SIZE_Z).select("mx", "mz")
    passes = [T.load_tile(asked, raw_, terrain, surf).select(F.lit(n).alias("pass"), "*") for n in (1, 2)]
    return passes[0].unionByName(passes[1])


def stored_circles(w, far: int, near: int, radius: int):
    """Two circles for each strip of the world, one of which can't be served."""
    return w.sql(f"SELECT CAST(2 * s + k AS INT) AS circle, CAST(96 * s + IF(k = 1, {far}, {near}) AS INT) AS cx, CAST(IF(k = 1, {far}, 48) AS INT) AS cz, {radius} AS radius FROM :strips, (VALUES (1), (2)) AS t(k)")


def circles_sql(far: int, near: int, radius: int, stored: str) -> str:
    return f"""circles AS (SELECT (2 * s + k)::INT AS circle, 96 * s + CASE k WHEN 1 THEN {far} ELSE {near} END AS cx, CASE k WHEN 1 THEN {far} ELSE 48 END AS cz FROM (SELECT unnest(range(0, scale)) AS s FROM extent) strip, (VALUES (1), (2)) t(k)),
  disc AS (SELECT circle, (cx + i)::INT AS x, (cz + j)::INT AS z FROM circles, range(-{radius}, {radius} + 1) a(i), range(-{radius}, {radius} + 1) b(j) WHERE i * i + j * j <= {radius * radius}),
  held AS (SELECT d.*, s.* EXCLUDE (x, z), s.x IS NOT NULL AS there FROM disc d LEFT JOIN {stored} s ON s.x = d.x AND s.z = d.z),
  gate AS (SELECT circle, bool_and(there AND x BETWEEN 0 AND 96 * scale - 1 AND z BETWEEN 0 AND 95) AS served FROM held, extent GROUP BY circle)"""


@plans("p15_rock_map_stored", f"""
WITH {rock_sql(0, 127)}, {circles_sql(45, 5, 20, 'rock')}
SELECT circle, served, x, z, state, rock_id, rock_code, y FROM held JOIN gate USING (circle) WHERE served UNION ALL SELECT circle, served, NULL, NULL, NULL, NULL, NULL, NULL FROM gate WHERE NOT served""")
def p15(w):
    path, size = scratch(w, "rock"), (w.size[0], SIZE_Z)
    T.write_upper_rock(upper(w).withColumns({"size_x": F.lit(size[0]), "size_z": F.lit(size[1])}), path)
    stored = w.spark.read.parquet(path)
    return stored_columns(stored, stored_circles(w, 45, 5, 20), *size).select("circle", "served", "x", "z", "state", "rock_id", "rock_code", "y")


@plans("p15_rock_legend_stored", f"""
WITH {rock_sql(0, 127)}, {circles_sql(45, 5, 20, 'rock')}
SELECT circle, served, state, rock_code, count(*) AS columns FROM held JOIN gate USING (circle) WHERE served GROUP BY ALL UNION ALL SELECT circle, served, NULL, NULL, NULL FROM gate WHERE NOT served""")
def p15_legend(w):
    path, size = scratch(w, "rock"), (w.size[0], SIZE_Z)
    T.write_upper_rock(upper(w).withColumns({"size_x": F.lit(size[0]), "size_z": F.lit(size[1])}), path)
    return stored_legend(w.spark.read.parquet(path), stored_circles(w, 45, 5, 20), *size)


STORED_SURFACE = f"{SURFACE}, {TILES}, stored AS (SELECT t.x, t.z, class FROM tiles t LEFT JOIN surf s ON s.x = t.x AND s.z = t.z WHERE NOT (t.x // 32 % 3 = 2 AND t.z // 32 = 2)), {circles_sql(30, 48, 28, 'stored')}"


def stored_surface(w):
    path = scratch(w, "surface")
    tiles_ = T.surface_tiles(resolved(w), mapchunks(w).where("NOT (mx % 3 = 2 AND mz = 2)"))
    T.write_surface(tiles_.withColumns({"size_x": F.lit(w.size[0]), "size_z": F.lit(SIZE_Z)}), path)
    return w.spark.read.parquet(path)


@plans("p16_surface_stored", f"""
WITH {STORED_SURFACE}
SELECT circle, served, x, z, class FROM held JOIN gate USING (circle) WHERE served UNION ALL SELECT circle, served, NULL, NULL, NULL FROM gate WHERE NOT served""")
def p16(w):
    return stored_columns(stored_surface(w), stored_circles(w, 30, 48, 28), w.size[0], SIZE_Z).select("circle", "served", "x", "z", "class")


@plans("p16_surface_pixels_stored", f"""
WITH {STORED_SURFACE}, boxed AS (SELECT circle, x, z, class, greatest(0, floor((x - c.cx + 28) * (85 / 56.0::DOUBLE)))::INT AS a, least(85, ceil((x + 1 - c.cx + 28) * (85 / 56.0::DOUBLE)))::INT AS b,
    greatest(0, floor((z - c.cz + 28) * (85 / 56.0::DOUBLE)))::INT AS c, least(85, ceil((z + 1 - c.cz + 28) * (85 / 56.0::DOUBLE)))::INT AS d FROM held JOIN gate USING (circle) JOIN circles c USING (circle) WHERE served AND class IS NOT NULL)
SELECT circle, true AS served, px::INT AS px, pz::INT AS pz, arg_max(class, {{'a': z // 32, 'b': x // 32, 'c': z, 'd': x}}) AS class FROM boxed, range(0, 85) p(px), range(0, 85) q(pz) WHERE px >= a AND px < b AND pz >= c AND pz < d GROUP BY circle, px, pz
UNION ALL SELECT circle, served, NULL, NULL, NULL FROM gate WHERE NOT served""")
def p16_pixels(w):
    circles = stored_circles(w, 30, 48, 28).withColumn("pixels_per_block", F.expr("CAST(1.5 AS DOUBLE)"))
    return stored_pixels(stored_surface(w), circles, w.size[0], SIZE_Z)


# -- chunk tables in buckets


def in_buckets(w, buckets: int = 8):
    """Voxels, heights, liquids and coverage in the same buckets of chunk columns."""
    w.keep_voxels()
    names = ("voxels", "heights", "liquids", "chunk_cov")
    bucketed.co_located(w.spark)
    return [bucketed.write(getattr(w, n), scratch(w, n), buckets) for n in names]


@plans("a3_upper_rock_buckets", f"WITH {rock_sql(0, 127).replace(CELLS, 'cells AS (SELECT DISTINCT x, z FROM voxels)')} SELECT * FROM rock")
def a3_buckets(w):
    voxels, _, _, coverage = in_buckets(w)
    return rock.upper_rock(voxels, w.registry, coverage, voxels.select("cx", "cz", "x", "z"), 0, SIZE_Y - 1)


@plans("p4_resolve_surface_buckets", f"WITH {SURFACE} SELECT x, z, path, y, block_id, liquid_id, class FROM surf")
def p4_buckets(w):
    voxels, heights, liquids, coverage = in_buckets(w)
    return surface.resolve_surface(voxels.select("cx", "cz", "x", "z"), heights, voxels, w.registry, liquids, coverage, no_liquids(w), SIZE_Y)


# -- tiles


def argb_sql(r, g, b):
    return f"(({r})::BIGINT * 65536 + ({g})::BIGINT * 256 + ({b})::BIGINT - 16777216)::INT"


BOUNDS = "bounds AS (SELECT DISTINCT x // 64 AS tx, z // 64 AS tz, greatest(x // 64 * 64, 0) AS x0, least(x // 64 * 64 + 64, 96 * (SELECT scale FROM extent)) AS x1, greatest(z // 64 * 64, 0) AS z0, least(z // 64 * 64 + 64, 96) AS z1 FROM voxels)"


def bounds(w):
    return tiles.tile_bounds(w.voxels.select(G.to_chunk(F.col("x")).alias("mx"), G.to_chunk(F.col("z")).alias("mz")), 2, w.size[0], SIZE_Z)


@plans("r1_sample_grid", f"WITH {BOUNDS} SELECT tx, tz, 2 AS lod, px::INT AS px, pz::INT AS pz, least(x0 + px*4 + 2, x1 - 1)::INT AS x, least(z0 + pz*4 + 2, z1 - 1)::INT AS z FROM bounds, range(0, 16) a(px), range(0, 16) b(pz) WHERE px < ceil((x1 - x0) / 4) AND pz < ceil((z1 - z0) / 4)")
def r1(w):
    return tiles.sample_grid(bounds(w), 2)


RASTERS = "SELECT CAST(s_suppkey AS INT) AS s_suppkey, CAST(s_suppkey * 7 % (96 * :scale) AS INT) AS cx, CAST(s_suppkey * 5 % 96 AS INT) AS cz, CAST(2 + s_suppkey % 12 AS INT) AS radius, CAST(1 + s_suppkey % 3 AS INT) AS pixels_per_block FROM {supplier}"


def raster_sql(width, raster, offset):
    """Pixels of each request's raster with the column that each one shows."""
    at = lambda c, p: f"c{c} - radius + least(width - 1, {offset.format(p=p)})"
    return f"""WITH req AS (SELECT *, {width} AS width FROM ({for_oracle(RASTERS)})), sized AS (SELECT *, {raster} AS raster FROM req),
  at_ AS (SELECT s_suppkey, px::INT AS px, pz::INT AS pz, ({at("x", "px")})::INT AS x, ({at("z", "pz")})::INT AS z FROM sized, range(0, 80) a(px), range(0, 80) b(pz) WHERE px < raster AND pz < raster)
SELECT s_suppkey, px, pz, at_.x, at_.z, rain_y FROM at_ JOIN heights h ON h.x = at_.x AND h.z = at_.z"""


@plans("r1_request_raster", raster_sql("2 * radius", "least(greatest(2 * radius * pixels_per_block + 1, 64), 4096)", "floor({p} / (raster / width::DOUBLE))"))
def r1_request(w):
    return tiles.raster_samples(w.heights.select("x", "z", "rain_y"), tiles.request_axes(w.sql(RASTERS)), "s_suppkey")


@plans("r1_rock_raster", raster_sql("2 * radius + 1", "least(width, 16)", "floor(({p} + 0.5::DOUBLE) * width / raster::DOUBLE)"))
def r1_rock(w):
    return tiles.raster_samples(w.heights.select("x", "z", "rain_y"), tiles.rock_axes(w.sql(RASTERS), 16), "s_suppkey")


@plans("r2_raster_size", "SELECT c_custkey, least(greatest((c_custkey % 3000) * 2 * (c_custkey % 4 + 1) + 1, 64), 4096)::INT AS raster FROM customer")
def r2(w):
    return w.table("customer").select("c_custkey", tiles.raster_size(F.expr("c_custkey % 3000"), F.expr("c_custkey % 4 + 1")).alias("raster"))


def shade_sql(step):
    return f"""sh AS (SELECT h.x, h.z, h.rain_y AS h, CASE WHEN e.rain_y + w.rain_y + s.rain_y + n.rain_y IS NULL THEN 0.0::DOUBLE ELSE least(greatest((-(e.rain_y - w.rain_y)::DOUBLE * 0.55::DOUBLE - (s.rain_y - n.rain_y)::DOUBLE * 0.75::DOUBLE) / 32.0::DOUBLE, -0.35::DOUBLE), 0.35::DOUBLE) END AS shade
  FROM heights h LEFT JOIN heights w ON w.x = h.x - {step} AND w.z = h.z LEFT JOIN heights e ON e.x = h.x + {step} AND e.z = h.z
  LEFT JOIN heights n ON n.x = h.x AND n.z = h.z - {step} LEFT JOIN heights s ON s.x = h.x AND s.z = h.z + {step}), span AS (SELECT min(rain_y) AS low, max(rain_y) AS high FROM heights)"""


def shaded(w, step=1):
    near = tiles.neighbours4(w.heights.select("x", "z", F.col("rain_y").alias("height")), step)
    return near.withColumn("shade", P.hillshade(*(F.col(c) for c in ("west", "east", "north", "south"))))


@plans("r3_hillshade", f"WITH {shade_sql(1)} SELECT x, z, shade FROM sh")
def r3(w):
    return shaded(w).select("x", "z", "shade")


def terrain_sql(style):
    n = "(CASE WHEN high <= low THEN 0.5::DOUBLE ELSE least(greatest((h - low) / (high - low)::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) END)"
    if style == "HIGH_CONTRAST":
        contrast, base = 1.35, [f"CASE WHEN {n} >= 0.5 THEN 255 ELSE 21 END"] * 3
    else:
        a, b, contrast = P.GRADIENTS[style]
        base = [f"floor({lo} + ({hi} - {lo}) * {n} + 0.5::DOUBLE)" for lo, hi in zip(a, b)]
    factor = f"least(greatest(0.78::DOUBLE + {n} * 0.42::DOUBLE + shade * {contrast}::DOUBLE, 0.35::DOUBLE), 1.7::DOUBLE)"
    return argb_sql(*[f"least(255, floor(({c}) * {factor}))" for c in base])


@plans("r4_terrain_argb", f"WITH {shade_sql(1)} SELECT x, z, {terrain_sql('SIMPLE')} AS simple, {terrain_sql('TOPOGRAPHIC')} AS topographic, {terrain_sql('HIGH_CONTRAST')} AS high_contrast FROM sh, span")
def r4(w):
    rows = shaded(w).join(F.broadcast(tiles.height_range(w.heights.select(F.col("rain_y").alias("height")))))  # one row
    colour = lambda s: P.terrain_argb(F.col("height"), F.col("low"), F.col("high"), F.col("shade"), s)
    return rows.select("x", "z", colour("SIMPLE").alias("simple"), colour("TOPOGRAPHIC").alias("topographic"), colour("HIGH_CONTRAST").alias("high_contrast"))


def surface_sql(shade="shade"):
    pick = lambda by: "CASE class " + " ".join(f"WHEN '{k}' THEN {v >> by & 255}" for k, v in P.SURFACE.items()) + " END"
    factor = f"least(greatest(1.0::DOUBLE + CASE class WHEN 'WATER' THEN {shade} * 0.2::DOUBLE WHEN 'SNOW' THEN {shade} * 0.45::DOUBLE ELSE {shade} END, 0.68::DOUBLE), 1.32::DOUBLE)"
    return argb_sql(*[f"least(255, floor(({pick(by)}) * {factor}))" for by in (16, 8, 0)])


@plans("r5_surface_argb", f"WITH {SURFACE}, {shade_sql(1)} SELECT surf.x, surf.z, {surface_sql()} AS argb FROM surf JOIN sh ON surf.x = sh.x AND surf.z = sh.z")
def r5(w):
    return resolved(w).join(shaded(w), ["x", "z"]).select("x", "z", P.surface_argb(F.col("class"), F.col("shade")).alias("argb"))


def blend_sql(back, tier="tier"):
    pick = lambda i: f"CASE {tier} " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in P.SOIL.items()) + " END"
    mixed = [f"floor((({pick(i)}) * {P.SOIL_ALPHA} + (({back}) >> {by} & 255) * {255 - P.SOIL_ALPHA}) / 255)" for i, by in enumerate((16, 8, 0))]
    return f"CASE WHEN {tier} IS NULL THEN {back} ELSE {argb_sql(*mixed)} END"


@plans("r6_soil_blend", f"WITH {SOILMAP} SELECT x, z, tier, {blend_sql('(-12345678 + x * 999 + z)')} AS argb FROM soil")
def r6(w):
    surf = resolved(w).where("class NOT IN ('WATER', 'SNOW')")
    dim = w.registry.withColumn("tier", C.soil_fertility(F.col("code"))["tier"]).select("block_id", "tier")
    back = (F.lit(-12345678) + F.col("x") * 999 + F.col("z")).cast("int")
    return surf.join(dim, "block_id").select("x", "z", "tier", P.soil_blend(back, F.col("tier")).alias("argb"))


@plans("r7_surface_cover", f"""
WITH {SURFACE}, near AS (SELECT surf.*, s, x - 96 * s AS dx FROM surf, (SELECT unnest(range(0, scale)) AS s FROM extent) strip)
SELECT s::INT AS raster_id, px::INT AS px, pz::INT AS pz, arg_max(class, {{'a': z // 32, 'b': x // 32, 'c': z, 'd': x}}) AS class FROM near, range(0, 64) p(px), range(0, 64) q(pz)
WHERE px >= floor(dx * 0.625::DOUBLE) AND px < least(ceil((dx + 1) * 0.625::DOUBLE), 64) AND pz >= floor(z * 0.625::DOUBLE) AND pz < least(ceil((z + 1) * 0.625::DOUBLE), 64) GROUP BY ALL""")
def r7(w):
    rasters = w.sql("SELECT CAST(s AS INT) AS raster_id, CAST(96 * s AS INT) AS x0, 0 AS z0, CAST(0.625 AS DOUBLE) AS scale, 64 AS raster FROM :strips")
    return tiles.surface_cover(resolved(w), rasters)


def rock_colour_sql(highlight=None):
    known = "CASE rock_code " + " ".join(f"WHEN '{k}' THEN {v - 0x1000000}" for k, v in P.ROCK.items()) + " ELSE fallback END"
    if highlight:
        dim = argb_sql(*[f"floor((({known}) >> {by} & 255) / 4)" for by in (16, 8, 0)])
        known = f"CASE WHEN rock_code = '{highlight}' THEN {known} ELSE {dim} END"
    return f"CASE state WHEN 'OBSERVED' THEN {known} WHEN 'NO_ROCK' THEN {P.NO_ROCK - 0x1000000} ELSE CASE WHEN (x + z) % 2 = 0 THEN {P.UNAVAILABLE_LIGHT - 0x1000000} ELSE {P.UNAVAILABLE_DARK - 0x1000000} END END"


def hsv_sql(hue, s, v):
    h = f"({hue} * 6)"
    f = f"({h} - floor({h}))"
    vv, p, q, t = f"{v}::DOUBLE", f"({v} * (1 - {s}))::DOUBLE", f"({v}::DOUBLE * (1 - {s}::DOUBLE * {f}))", f"({v}::DOUBLE * (1 - {s}::DOUBLE * (1 - {f})))"
    pick = lambda *by: f"floor((CASE floor({h})::INT " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(by)) + " END) * 255 + 0.5::DOUBLE)"
    return argb_sql(pick(vv, q, p, p, t, vv), pick(t, vv, vv, q, p, p), pick(p, p, t, vv, vv, q))


FNV = "list_reduce(list_prepend(2216829733::BIGINT, list_transform(string_split(rock_code, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 435) & 4294967295)"


@plans("r8_rock_argb", f"""
WITH {rock_sql(0, 127)}, f AS (SELECT *, CASE WHEN rock_code IS NOT NULL THEN {hsv_sql(f'({FNV} / 4294967296.0::DOUBLE)', 0.62, 0.78)} END AS fallback FROM rock)
SELECT x, z, {rock_colour_sql()} AS argb, {rock_colour_sql('game:rock-basalt')} AS highlighted FROM f""")
def r8(w):
    s, c, x, z = (F.col(k) for k in ("state", "rock_code", "x", "z"))
    return upper(w).select("x", "z", P.rock_argb(s, c, x, z).alias("argb"), P.rock_argb(s, c, x, z, "game:rock-basalt").alias("highlighted"))


@plans("r9_ore_alpha", "SELECT x, z, floor(85 + 110 * least(1.0::DOUBLE, log10(count(*) + 1.0::DOUBLE)) + 0.5::DOUBLE)::INT AS alpha FROM voxels WHERE block_id BETWEEN 5 AND 8 GROUP BY x, z")
def r9(w):
    counts = w.voxels.where("block_id BETWEEN 5 AND 8").groupBy("x", "z").agg(F.count(F.lit(1)).alias("blocks"))
    return counts.select("x", "z", ore.ore_alpha(F.col("blocks")).alias("alpha"))


def environment_sql():
    count = "(1" + "".join(f" + list_contains(labels, '{k}')::INT" for k in P.ENVIRONMENT) + ")"
    mean = [f"floor(({P.ENVIRONMENT_BASE[i]}" + "".join(f" + list_contains(labels, '{k}')::INT * {v[i]}" for k, v in P.ENVIRONMENT.items()) + f") / {count})" for i in range(3)]
    base = ["CASE WHEN d IS NULL THEN 110 ELSE floor(150 - d * 65 + 0.5::DOUBLE) END", "CASE WHEN d IS NULL THEN 125 ELSE floor(125 + d * 90 + 0.5::DOUBLE) END", "CASE WHEN d IS NULL THEN 110 ELSE 105 END"]
    add = ["t / 255.0::DOUBLE * 55", "r / 255.0::DOUBLE * 45", "(1.0::DOUBLE - t / 255.0::DOUBLE) * 40"]
    tint = [f"CASE WHEN t IS NULL THEN {b} ELSE least(greatest(floor({b} + {a} + 0.5::DOUBLE), 0), 255) END" for b, a in zip(base, add)]
    return f"CASE WHEN len(labels) > 0 THEN {argb_sql(*mean)} ELSE {argb_sql(*tint)} END"


@plans("r10_region_argb", f"WITH {PROFILES} SELECT rx, rz, {environment_sql()} AS argb, {hsv_sql('((id::DOUBLE * 0.6180339887498949::DOUBLE) - floor(id::DOUBLE * 0.6180339887498949::DOUBLE))', 0.55, 0.95)} AS province FROM (SELECT *, province_top[1] AS id, {LABELS_SQL} AS labels FROM prof)")
def r10(w):
    p = regions.environment_profiles(inner(w))
    return p.select("rx", "rz", P.environment_argb(F.col("labels"), F.col("density"), F.col("temperature"), F.col("rain")).alias("argb"), P.province_argb(F.get("province_top", 0)).alias("province"))


def pyramid_sql(lod):
    b = 1 << lod
    return f"""SELECT tx, tz, {lod} AS lod, px, pz, argb FROM (
  SELECT tx, tz, px, pz, {blend_sql('top')} AS argb FROM (
    SELECT g.*, soil.tier, CASE WHEN surf.class IS NOT NULL THEN {surface_sql('coalesce(shade, 0.0::DOUBLE)')} ELSE CASE WHEN h IS NOT NULL THEN {terrain_sql('SIMPLE')} END END AS top
    FROM (SELECT tx, tz, px::INT AS px, pz::INT AS pz, least(x0 + px*{b} + {b // 2}, x1 - 1)::INT AS x, least(z0 + pz*{b} + {b // 2}, z1 - 1)::INT AS z FROM bounds, range(0, 64) a(px), range(0, 64) b(pz)
      WHERE px < ceil((x1 - x0) / {b}) AND pz < ceil((z1 - z0) / {b})) g LEFT JOIN sh{lod} sh ON g.x = sh.x AND g.z = sh.z LEFT JOIN surf ON surf.x = g.x AND surf.z = g.z LEFT JOIN soil ON soil.x = g.x AND soil.z = g.z, span) t) u WHERE argb IS NOT NULL"""


_SHADES = ", ".join(shade_sql(1 << lod).replace("sh AS (", f"sh{lod} AS (", 1).split(", span AS")[0] for lod in range(6))


@plans("p13_tile_pyramid", f"WITH {SOILMAP}, {BOUNDS}, {_SHADES}, span AS (SELECT min(rain_y) AS low, max(rain_y) AS high FROM heights) {' UNION ALL '.join(pyramid_sql(lod) for lod in range(6))}")
def p13(w):
    surf, _ = store(resolved(w), "surface")
    return tiles.tile_pyramid(bounds(w), w.heights.select("x", "z", F.col("rain_y").alias("height")), surf, surface.soil_map(surf, w.registry))


# -- streams


SAVED = "SELECT DISTINCT CAST(user_id % 4 AS INT) AS w, CAST(user_id % 500 AS INT) AS mx, CAST(event_id % 30 AS INT) AS mz, event_id % 13 = 0 AS other FROM {events}"


@plans("t1_stream_discovery", f"SELECT DISTINCT 'world' || w AS world, mx, mz, true AS complete FROM ({SAVED.replace('{events}', 'events')}) WHERE NOT other")
def t1(w):
    from ..streaming import refresh

    rows = w.sql(SAVED).select(
        F.concat(F.lit("world"), "w").alias("world"), G.encode_position(F.col("mx"), F.lit(0), F.col("mz"), F.when(F.col("other"), 2).otherwise(0)).alias("position"), F.lit(b"\0").alias("data"))
    saves, path = scratch(w, "saves"), scratch(w, "discovered")
    savefile.write_saves(rows, saves)
    w.spark.dataSource.register(savefile.SaveFile)
    pages = w.spark.readStream.format("loam_save").options(table="mapchunk", page=2048, payload="false").load(saves)
    query = refresh.stream_discovery(pages, path, scratch(w, "offsets"))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    mark = w.spark.read.parquet(f"{path}/complete")
    return w.spark.read.parquet(f"{path}/keys").join(F.broadcast(mark))  # one row


def delivered(w):
    """Raw chunks of the voxels as they arrive: first, for a third of them, an old
    payload, and last, for one in thirteen, one that is cut short; and the order of
    arrival, in which some old payloads come after the new ones."""
    whole = store(encode.raw_chunks(w.voxels), "whole")[0]  # two kinds of arrivals are made of it
    number = F.expr("(cx * 1009 + cy * 31 + cz) * 4")
    old = encode.raw_chunks(w.voxels.where("y % 3 = 0")).where("(cx + cy + cz) % 3 = 0").withColumn("event_id", number)
    cut = whole.where("(cx * 5 + cy * 7 + cz * 11) % 13 = 1").withColumns({"data": F.expr("substring(data, 1, 40)"), "event_id": number + 2})
    rows = old.unionByName(whole.withColumn("event_id", number + 1)).unionByName(cut)
    return rows.select("event_id", "position", "data", F.expr("event_id + IF(event_id % 4 = 0 AND cx % 2 = 1, 100000, 0)").alias("arrival"))


@plans("t2_stream_index", f"""
WITH o AS (SELECT o.* FROM ({OCCURRENCES}) o JOIN registry r ON r.block_id = o.block_id WHERE code LIKE 'ore-%' OR code LIKE '%:ore-%'),
  c AS (SELECT cx, cy, cz, (cx * 1009 + cy * 31 + cz) * 4 AS number, (cx * 5 + cy * 7 + cz * 11) % 13 = 1 AS cut FROM chunk_cov)
SELECT c.cx, c.cy, c.cz, (CASE WHEN cut THEN number + 2 ELSE number + 1 END)::BIGINT AS event_id, CASE WHEN cut THEN 'FAILED' ELSE 'AVAILABLE' END AS status, block_id, lx, lz, y_mask
FROM c LEFT JOIN o ON NOT cut AND o.cx = c.cx AND o.cy = c.cy AND o.cz = c.cz""")
def t2(w):
    from ..streaming import refresh

    w.keep_voxels()
    files, path = scratch(w, "arrivals"), scratch(w, "indexed")
    rows = store(delivered(w), "delivered")[0]
    rows.repartitionByRange(4, "arrival").write.parquet(files)
    stream = w.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(files)
    refresh.stream_index(stream, w.registry, w.size, path, scratch(w, "offsets")).awaitTermination()
    found = ore.y_masks(w.voxels).schema
    coverage = published.read(w.spark, path, T.COVERAGE, StructType.fromDDL("cx int, cy int, cz int, status string, event_id long"))
    occurrences = published.read(w.spark, path, T.OCCURRENCES, found).drop("rx", "rz")
    return coverage.join(occurrences, ["cx", "cy", "cz"], "left").select("cx", "cy", "cz", "event_id", "status", "block_id", "lx", "lz", "y_mask")
