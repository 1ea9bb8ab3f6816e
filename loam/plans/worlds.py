"""Queries of the joins, aggregates, rankings and composite jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import geometry as G
from ..operators import components as K
from ..operators import objects as O
from ..operators import ore, prospecting, regions, rock, surface
from ..operators.dims import large, small
from ..sources import decode, encode
from .base import Plans
from .scalars import LABELS_SQL, FOREST_SQL, OBJECT_SQL, PATH_SQL, SOIL_SQL, SURFACE_CODE_SQL, SURFACE_SQL
from .worldviews import COLUMNS_X, MAPCHUNKS_X, SIZE_Y, SIZE_Z, for_oracle

plans = Plans()
queries, oracle_sql = plans.queries, plans.oracle_sql
CK = ["cx", "cy", "cz"]

# -- shared SQL

MEMBER = "member AS (SELECT DISTINCT resource, block_id FROM registry, requests WHERE regexp_matches(code, '^([^:]*:)?ore-') AND contains(regexp_replace(code, '^[^:]*:', ''), resource))"
HITS = MEMBER + ", hits AS (SELECT r.request_id, r.resource, v.x, v.y, v.z, v.block_id FROM {v} v JOIN member m USING (block_id) JOIN requests r ON r.resource = m.resource AND (x-cx)*(x-cx) + (z-cz)*(z-cz) <= radius*radius AND y BETWEEN y_min AND y_max)"
COLUMNS = HITS + ", cols AS (SELECT request_id, resource, x, z, count(*) AS blocks, min(y) AS min_y, max(y) AS max_y FROM hits GROUP BY ALL)"
AVAIL = "avail AS (SELECT v.* FROM voxels v JOIN chunk_cov c ON c.cx = x // 32 AND c.cy = y // 32 AND c.cz = z // 32 WHERE status = 'AVAILABLE')"
PLAN = f"""plan AS (SELECT DISTINCT request_id, mx::INT AS cx, my::INT AS cy, mz::INT AS cz FROM requests, {MAPCHUNKS_X}, range(0, 3) b(mz), range(0, 4) c(my)
  WHERE (cx - greatest(mx*32, least(cx, mx*32+31)))**2 + (cz - greatest(mz*32, least(cz, mz*32+31)))**2 <= radius*radius AND my BETWEEN y_min // 32 AND y_max // 32)"""
ROCKS = r"rocks AS (SELECT block_id, code AS rock_code FROM registry WHERE regexp_matches(code, '^([\p{L}\p{Nd}_.-]+:)?rock-[\p{L}\p{Nd}_.-]+$'))"
CELLS = f"cells AS (SELECT DISTINCT request_id, x::INT AS x, z::INT AS z FROM requests, {COLUMNS_X}, range(0, 96) b(z) WHERE (x-cx)*(x-cx) + (z-cz)*(z-cz) <= radius*radius)"


def rock_sql(low: int, high: int) -> str:
    """CTEs up to rock(x, z, state, rock_id, rock_code, y) over the cells."""
    return f"""{AVAIL}, {ROCKS}, {CELLS},
  need AS (SELECT DISTINCT x // 32 AS cx, z // 32 AS cz, cy::INT AS cy FROM cells, range({low // 32}, {high // 32 + 1}) r(cy)),
  gaps AS (SELECT n.cx, n.cz, max(CASE WHEN coalesce(status, '') <> 'AVAILABLE' THEN n.cy END) AS gap FROM need n LEFT JOIN chunk_cov c ON n.cx = c.cx AND n.cy = c.cy AND n.cz = c.cz GROUP BY n.cx, n.cz),
  tops AS (SELECT x, z, max({{'y': y, 'b': block_id, 'c': rock_code}}) AS t FROM avail JOIN rocks USING (block_id) WHERE y BETWEEN {low} AND {high} GROUP BY x, z),
  judged AS (SELECT s.x, s.z, t, CASE WHEN t IS NOT NULL AND (gap IS NULL OR (t.y + 1) // 32 > gap) THEN 'OBSERVED' WHEN t IS NULL AND gap IS NULL THEN 'NO_ROCK' ELSE 'UNAVAILABLE' END AS state
    FROM (SELECT DISTINCT x, z FROM cells) s LEFT JOIN tops ON s.x = tops.x AND s.z = tops.z JOIN gaps ON gaps.cx = s.x // 32 AND gaps.cz = s.z // 32),
  rock AS (SELECT x, z, state, CASE WHEN state = 'OBSERVED' THEN t.b END AS rock_id, CASE WHEN state = 'OBSERVED' THEN t.c END AS rock_code, CASE WHEN state = 'OBSERVED' THEN t.y END AS y FROM judged)"""


def classed_sql(voxels: str = "voxels", liquid: str = "coalesce(l.liquid_id, 0)") -> str:
    """CTE classed(x, y, z, block_id, code, lid, class, class_code, ground)."""
    return f"""classed AS (SELECT *, {SURFACE_CODE_SQL} AS class_code,
    NOT (block_id = 0 OR coalesce(code, '') = 'game:air') AND (class = 'WATER' OR NOT regexp_matches(coalesce(code, ''), '{"|".join(C.FOLIAGE)}')) OR class = 'WATER' AND lid <> 0 AS ground
    FROM (SELECT *, {SURFACE_SQL} AS class FROM (
      SELECT v.x, v.y, v.z, v.block_id, r.code, {liquid} AS lid, q.code AS lcode FROM {voxels} v LEFT JOIN registry r ON v.block_id = r.block_id
      LEFT JOIN liquids l ON v.x = l.x AND v.y = l.y AND v.z = l.z LEFT JOIN registry q ON q.block_id = {liquid})))"""


SURFACE = f"""{AVAIL}, {classed_sql('avail')},
  asked AS (SELECT DISTINCT x, z FROM voxels),
  fl AS (SELECT a.x, a.z, h.rain_y, c.block_id, c.lid, c.class, (h.rain_y IS NULL OR (a.x // 32 = 0 AND a.z // 32 = 2) OR c.block_id IS NULL OR NOT coalesce(c.ground, false)) AS bad
    FROM asked a LEFT JOIN heights h ON a.x = h.x AND a.z = h.z LEFT JOIN classed c ON c.x = a.x AND c.z = a.z AND c.y = h.rain_y),
  fb AS (SELECT x // 32 AS mx, z // 32 AS mz, bool_or(bad) AS fallback FROM fl GROUP BY ALL),
  fast AS (SELECT x, z, 'FAST' AS path, rain_y AS y, block_id, lid AS liquid_id, class FROM fl JOIN fb ON mx = x // 32 AND mz = z // 32 WHERE NOT fallback),
  dry AS (SELECT * FROM (SELECT *, {SURFACE_CODE_SQL} AS class_code, NOT (block_id = 0 OR coalesce(code, '') = 'game:air') AND (class = 'WATER' OR NOT regexp_matches(coalesce(code, ''), '{"|".join(C.FOLIAGE)}')) OR class = 'WATER' AND lid <> 0 AS ground
    FROM (SELECT x, y, z, block_id, CASE WHEN x // 32 = 0 AND z // 32 = 2 THEN 0 ELSE lid END AS lid,
      CASE WHEN x // 32 = 0 AND z // 32 = 2 THEN {SURFACE_SQL.replace('lcode', 'NULL').replace('lid <>', '0 <>')} ELSE class END AS class, code FROM classed))),
  slow AS (SELECT x, z, max({{'y': y, 'b': block_id, 'l': lid, 'k': class_code, 'c': class}}) AS t FROM dry JOIN fb ON mx = x // 32 AND mz = z // 32 WHERE fallback AND ground GROUP BY x, z),
  surf AS (SELECT * FROM fast UNION ALL SELECT x, z, 'FALLBACK', t.y, t.b, t.l, t.c FROM slow)"""

INNER = "inn AS (SELECT *, rx*512 + (lx-1)*32.0::DOUBLE AS x0, rx*512 + lx*32.0::DOUBLE AS x1, rz*512 + (lz-1)*32.0::DOUBLE AS z0, rz*512 + lz*32.0::DOUBLE AS z1 FROM layer_cells WHERE lx BETWEEN 1 AND 16 AND lz BETWEEN 1 AND 16)"


def no_liquids(w):
    return w.spark.range(1).selectExpr("0 AS mx", "2 AS mz")


def resolved(w):
    w.keep_voxels()
    return surface.resolve_surface(None, w.heights, w.voxels, w.registry, w.liquids, w.chunk_cov, no_liquids(w), SIZE_Y)


def inner(w):
    return G.inner_cells(w.layer_cells)


def ore_signals(w):
    """Signal cells named by the resources of the requests: layer ore:1 is
    nativecopper, ore:2 cassiterite, ore:3 galena, others keep their key."""
    names = F.create_map(*[F.lit(x) for kv in (("1", "nativecopper"), ("2", "cassiterite"), ("3", "galena")) for x in kv])
    s = regions.signal_relative(inner(w))
    return s.withColumn("resource", F.coalesce(names[F.col("resource")], "resource"))


SIGNALS = f"""{INNER}, sig AS (SELECT rx, rz, lx, lz, x0, x1, z0, z1, raw, res, CASE WHEN max(raw) OVER p = min(raw) OVER p THEN 0.0::DOUBLE ELSE (raw - min(raw) OVER p)::DOUBLE / (max(raw) OVER p - min(raw) OVER p) END AS relative
  FROM (SELECT *, substr(layer, 5) AS res FROM inn WHERE layer LIKE 'ore:%') WINDOW p AS (PARTITION BY res)),
  signal AS (SELECT * REPLACE (CASE res WHEN '1' THEN 'nativecopper' WHEN '2' THEN 'cassiterite' WHEN '3' THEN 'galena' ELSE res END AS res) FROM sig),
  best AS (SELECT r.request_id, r.resource, max(relative) AS signal FROM requests r LEFT JOIN signal s ON s.res = r.resource AND ((x0+x1)/2 - cx)**2 + ((z0+z1)/2 - cz)**2 <= radius*radius GROUP BY ALL)"""

# -- scans and lookups


def positions(w):
    return G.plan_chunks(w.requests, *w.size).select("request_id", F.col("mx").alias("cx"), F.col("my").alias("cy"), F.col("mz").alias("cz"))


@plans("s3_discover_coordinates", "SELECT DISTINCT x // 32 AS cx, z // 32 AS cz FROM voxels")
def s3(w):
    return w.voxels.select(G.to_chunk(F.col("x")).alias("cx"), G.to_chunk(F.col("z")).alias("cz")).distinct()


@plans("s6_lookup_chunks", f"WITH {PLAN} SELECT v.x // 32 AS cx, v.y // 32 AS cy, v.z // 32 AS cz, count(*) AS voxels, count(DISTINCT block_id) AS palette FROM voxels v WHERE (x // 32, y // 32, z // 32) IN (SELECT (cx, cy, cz) FROM plan ) GROUP BY ALL")
def s6(w):
    found = ore.lookup_chunks(ore.chunk_table(w.voxels), positions(w))
    return found.select(*CK, F.size("cells").cast("long").alias("voxels"), F.size("palette").cast("long").alias("palette"))


@plans("s7_selective_chunks", f"""
WITH {PLAN}, {MEMBER}, ch AS (SELECT x // 32 AS cx, y // 32 AS cy, z // 32 AS cz, count(*) AS voxels, bool_or(block_id IN (SELECT block_id FROM member)) AS want FROM voxels GROUP BY ALL)
SELECT cx, cy, cz, voxels FROM ch WHERE want AND (cx, cy, cz) IN (SELECT (cx, cy, cz) FROM plan)""")
def s7(w):
    found = ore.selective_chunks(ore.chunk_table(w.voxels), positions(w), ore.membership(w.registry, w.requests))
    return found.select(*CK, F.size("cells").cast("long").alias("voxels"))


@plans("s8_selective_chunks_coverage", f"""
WITH {PLAN}, {MEMBER}, ch AS (SELECT x // 32 AS cx, y // 32 AS cy, z // 32 AS cz, bool_or(block_id = 8) AS want FROM voxels GROUP BY ALL), p AS (SELECT DISTINCT cx, cy, cz FROM plan)
SELECT p.cx, p.cy, p.cz, CASE WHEN status = 'FAILED' THEN 'FAILED' WHEN want IS NULL OR coalesce(status, 'MISSING') = 'MISSING' THEN 'MISSING' WHEN want THEN 'DECODED' ELSE 'PALETTE_REJECTED' END AS visit
FROM p LEFT JOIN chunk_cov c ON p.cx = c.cx AND p.cy = c.cy AND p.cz = c.cz LEFT JOIN ch ON ch.cx = p.cx AND ch.cy = p.cy AND ch.cz = p.cz""")
def s8(w):
    return ore.chunk_visits(positions(w), ore.chunk_table(w.voxels), w.chunk_cov, w.registry.where("block_id = 8"))


HEADER = "SELECT 96 * scale AS size_x, 128 AS size_y, 96 AS size_z, (SELECT count(*) FROM registry) AS registered, (SELECT min(c_name || '/' || c_custkey) FROM customer) AS player, arg_min((c_custkey % (96 * scale))::INT, c_name || '/' || c_custkey) AS player_x, arg_min((c_custkey % 96)::INT, c_name || '/' || c_custkey) AS player_z FROM customer, extent GROUP BY scale"


def players(w):
    return w.sql("SELECT concat(c_name, '/', c_custkey) AS record, CAST(c_custkey % (96 * :scale) AS INT) AS x, CAST(c_custkey % 96 AS INT) AS z FROM {customer}")


def world_header(w):
    raw = encode.raw_registry(w.registry, w.size)
    return decode.world_header(decode.decode_world_meta(raw), decode.decode_registry(raw), players(w))


@plans("s9_world_header", HEADER)
def s9(w):
    return world_header(w)


# -- joins


@plans("j1_voxel_registry", "SELECT x, y, z, v.block_id, coalesce(code, 'unknown:' || v.block_id) AS code FROM voxels v LEFT JOIN registry r ON v.block_id = r.block_id")
def j1(w):
    return surface.with_codes(w.voxels, w.registry).select("x", "y", "z", "block_id", "code")


@plans("j2_wanted_voxels", f"WITH {MEMBER} SELECT x, y, z, block_id FROM voxels WHERE block_id IN (SELECT block_id FROM member)")
def j2(w):
    return w.voxels.join(small(ore.membership(w.registry, w.requests)), "block_id", "left_semi").select("x", "y", "z", "block_id")


@plans("j3_palette_semi", "SELECT x // 32 AS cx, y // 32 AS cy, z // 32 AS cz, count(DISTINCT block_id) AS palette FROM voxels GROUP BY ALL HAVING bool_or(block_id IN (7, 8))")
def j3(w):
    chunks = ore.chunk_table(w.voxels).where(F.arrays_overlap("palette", F.array(F.lit(7), F.lit(8))))
    return chunks.select(*CK, F.size("palette").cast("long").alias("palette"))


@plans("j4_resource_membership", f"WITH {MEMBER} SELECT resource, block_id, (SELECT count(*) FROM voxels v WHERE v.block_id = m.block_id) AS n FROM member m")
def j4(w):
    counts = w.voxels.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"))
    return ore.membership(w.registry, w.requests).join(counts, "block_id", "left").select("resource", "block_id", F.coalesce("n", F.lit(0)).alias("n"))


@plans("j5_requested_left", f"WITH {PLAN} SELECT request_id, p.cx, p.cy, p.cz, coalesce(status, 'MISSING') AS status FROM plan p LEFT JOIN chunk_cov c ON p.cx = c.cx AND p.cy = c.cy AND p.cz = c.cz")
def j5(w):
    return positions(w).distinct().join(w.chunk_cov, CK, "left").select("request_id", *CK, F.coalesce("status", F.lit("MISSING")).alias("status"))


@plans("j6_key_to_codes", "SELECT k.resource, code, n FROM (SELECT substr(layer, 5) AS resource, count(*) AS n FROM layer_cells WHERE layer LIKE 'ore:%' GROUP BY ALL UNION ALL SELECT 'granite', 0) k JOIN registry ON regexp_matches(code, '^([^:]*:)?ore-') AND contains(code, k.resource)")
def j6(w):
    keys = w.layer_cells.where("layer LIKE 'ore:%'").groupBy(F.expr("substr(layer, 5)").alias("resource")).agg(F.count(F.lit(1)).alias("n"))
    keys = keys.union(w.spark.range(1).selectExpr("'granite'", "0L"))
    return keys.join(small(w.registry), C.match_ore(F.col("code"), F.col("resource"))).select("resource", "code", "n")


@plans("j7_height_voxel", "SELECT h.x, h.z, h.rain_y, block_id FROM heights h LEFT JOIN voxels v ON h.x = v.x AND h.z = v.z AND h.rain_y = v.y")
def j7(w):
    return surface.height_voxels(w.heights, w.voxels)


@plans("j8_candidate_y_range", "SELECT h.x, h.z, v.y, v.block_id FROM heights h JOIN voxels v ON h.x = v.x AND h.z = v.z WHERE (v.y >= terrain_y - 2 AND v.y < terrain_y + 4) OR (v.y >= rain_y AND v.y < rain_y + 4)")
def j8(w):
    return w.voxels.join(O.candidate_heights(w.heights, SIZE_Y), ["x", "z", "y"]).select("x", "z", "y", "block_id")


CLAY = "clay AS (SELECT DISTINCT x, z FROM voxels WHERE block_id IN (22, 23))"


def clay_cells(w):
    return w.voxels.where("block_id IN (22, 23)").groupBy("x", "z").agg(F.max("y").alias("y"), F.max_by("block_id", "y").alias("block_id"))


@plans("j9_neighbours8", f"WITH {CLAY} SELECT a.x, a.z, b.x AS x2, b.z AS z2 FROM clay a JOIN clay b ON (b.x - a.x, b.z - a.z) IN ((1, 0), (0, 1), (1, 1), (1, -1))")
def j9(w):
    return K.neighbours8(clay_cells(w))


@plans("j10_neighbours4", """
SELECT h.x, h.z, w.rain_y AS west, e.rain_y AS east, n.rain_y AS north, s.rain_y AS south FROM heights h LEFT JOIN heights w ON w.x = h.x - 1 AND w.z = h.z
LEFT JOIN heights e ON e.x = h.x + 1 AND e.z = h.z LEFT JOIN heights n ON n.x = h.x AND n.z = h.z - 1 LEFT JOIN heights s ON s.x = h.x AND s.z = h.z + 1""")
def j10(w):
    from ..operators.tiles import neighbours4

    return neighbours4(w.heights.select("x", "z", F.col("rain_y").alias("height")), 1).select("x", "z", "west", "east", "north", "south")


@plans("j11_signal_in_area", f"WITH {SIGNALS} SELECT r.request_id, r.resource, rx, rz, lx, lz, relative FROM requests r JOIN signal s ON s.res = r.resource AND ((x0+x1)/2 - cx)**2 + ((z0+z1)/2 - cz)**2 <= 250000")
def j11(w):
    near = regions.signals_in_area(ore_signals(w), w.requests.withColumn("radius", F.lit(500)))
    return near.select("request_id", "resource", "rx", "rz", "lx", "lz", "relative")


HOST_PAIRS = "pairs AS (SELECT DISTINCT request_id, rock_code FROM cells JOIN rock ON cells.x = rock.x AND cells.z = rock.z WHERE state = 'OBSERVED')"
COMPAT_SQL = "hosts AS (SELECT r.request_id, r.resource, CASE max(CASE coalesce(verdict, 'UNKNOWN') WHEN 'COMPATIBLE' THEN 2 WHEN 'UNKNOWN' THEN 1 ELSE 0 END) WHEN 2 THEN 'COMPATIBLE' WHEN 1 THEN 'UNKNOWN' ELSE 'INCOMPATIBLE' END AS compatibility FROM pairs p JOIN requests r USING (request_id) LEFT JOIN compat c ON c.resource = r.resource AND c.rock_code = p.rock_code GROUP BY r.request_id, r.resource)"


def request_rock(w):
    w.keep_voxels()
    cells = G.circle_cells(w.requests.select("request_id", "cx", "cz", "radius").distinct()).where(G.in_world(F.col("x"), w.size[0]) & G.in_world(F.col("z"), SIZE_Z)).select("request_id", "x", "z")
    return cells.join(large(rock.upper_rock(w.voxels, w.registry, w.chunk_cov, cells, 0, SIZE_Y - 1)), ["x", "z"])  # Spark takes circles for as few rows as their requests


def upper(w):
    return request_rock(w).drop("request_id").distinct()


@plans("j12_ore_rock_compat", f"WITH {rock_sql(0, 127)}, {HOST_PAIRS}, {COMPAT_SQL} SELECT * FROM hosts")
def j12(w):
    pairs = request_rock(w).where("state = 'OBSERVED'").select("request_id", "rock_code").distinct().join(w.requests.select("request_id", "resource"), "request_id")
    return prospecting.host_compatibility(pairs, w.compat)


@plans("j13_missing_only", "SELECT DISTINCT x // 32 AS cx, y // 32 AS cy, z // 32 AS cz FROM voxels WHERE (x // 32, y // 32, z // 32) NOT IN (SELECT (cx, cy, cz) FROM chunk_cov WHERE status = 'AVAILABLE')")
def j13(w):
    from ..operators.tables import missing_only

    return missing_only(ore.chunk_table(w.voxels).select(*CK), w.chunk_cov.where("status = 'AVAILABLE'"), CK)


@plans("j14_known_absent", f"WITH {PLAN} SELECT DISTINCT cx, cy, cz FROM plan WHERE (cx, cy, cz) NOT IN (SELECT (cx, cy, cz) FROM arrivals) AND (SELECT count(*) FROM arrivals) > 0")
def j14(w):
    from ..operators.tables import known_absent

    complete = w.arrivals.agg((F.count(F.lit(1)) > 0).alias("complete"))
    return known_absent(positions(w).select(*CK), w.arrivals.select(*CK), complete, CK)


@plans("j15_grid_holes", """
WITH p AS (SELECT min(rx) AS a, max(rx) AS b, min(rz) AS c, max(rz) AS d FROM regions)
SELECT rx::INT AS rx, rz::INT AS rz FROM p, (SELECT unnest(range(a, b + 1)) AS rx FROM p) x, (SELECT unnest(range(c, d + 1)) AS rz FROM p) z WHERE rx BETWEEN a AND b AND rz BETWEEN c AND d AND (rx, rz) NOT IN (SELECT (rx, rz) FROM regions)""")
def j15(w):
    return regions.coverage_cells(w.regions, w.size[0], SIZE_Z).where("NOT present").select("rx", "rz")


@plans("j16_region_window", "SELECT request_id, resource, rx, rz FROM regions, requests WHERE rx*512 < cx + 3000 AND rx*512 + 512 > cx - 3000 AND rz*512 < cz + 3000 AND rz*512 + 512 > cz - 3000")
def j16(w):
    return regions.region_window(w.regions, w.requests.withColumn("radius", F.lit(3000))).select("request_id", "resource", "rx", "rz")


# -- aggregates


@plans("a1_ore_columns", f"WITH {COLUMNS.format(v='voxels')} SELECT * FROM cols")
def a1(w):
    return ore.ore_columns(w.voxels, w.registry, w.requests)


@plans("a2_ore_totals", f"WITH {COLUMNS.format(v='voxels')} SELECT r.request_id, r.resource, coalesce(sum(blocks), 0)::BIGINT AS blocks, count(x) AS hit_columns, coalesce(min(min_y), -1) AS min_y, coalesce(max(max_y), -1) AS max_y FROM requests r LEFT JOIN cols c ON r.request_id = c.request_id AND r.resource = c.resource GROUP BY ALL")
def a2(w):
    return ore.ore_totals(a1(w), w.requests)


@plans("a3_upper_rock", f"WITH {rock_sql(0, 127)} SELECT * FROM rock")
def a3(w):
    return upper(w)


@plans("a4_rock_at_y", f"WITH {rock_sql(40, 40)} SELECT * FROM rock")
def a4(w):
    cells = request_rock(w).select("x", "z").distinct()
    return rock.upper_rock(w.voxels, w.registry, w.chunk_cov, cells, 40, 40)


LEGEND = "legend AS (SELECT rock_code, count(*) AS columns, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS percent, row_number() OVER (ORDER BY count(*) DESC, rock_code) AS place FROM rock WHERE state = 'OBSERVED' GROUP BY rock_code)"


@plans("a5_rock_legend", f"WITH {rock_sql(0, 127)}, {LEGEND} SELECT * FROM legend UNION ALL SELECT state, count(*), NULL, NULL FROM rock GROUP BY state")
def a5(w):
    columns = upper(w)
    totals = rock.state_totals(columns).select(F.col("state").alias("rock_code"), "columns", F.lit(None).cast("double").alias("percent"), F.lit(None).cast("int").alias("place"))
    return rock.rock_legend(columns).unionByName(totals)


@plans("a6_surface_top", f"WITH {classed_sql()} SELECT x, z, t.y AS y, t.b AS block_id, t.l AS liquid_id, t.c AS class FROM (SELECT x, z, max({{'y': y, 'b': block_id, 'l': lid, 'k': class_code, 'c': class}}) AS t FROM classed WHERE ground GROUP BY x, z)")
def a6(w):
    w.keep_voxels()
    return surface.surface_top(w.voxels, w.registry, w.liquids)


SHOWN = "shown AS (SELECT s.*, coalesce(r.code, 'unknown:' || s.block_id) AS code FROM surf s LEFT JOIN registry r ON r.block_id = s.block_id)"


@plans("a7_surface_diagnostics", f"""
WITH {SURFACE}, {SHOWN} SELECT (SELECT count(*) FROM chunk_cov WHERE status = 'AVAILABLE' AND (cx, cz) IN (SELECT (x // 32, z // 32) FROM asked)) AS chunks_scanned,
  (SELECT count(*) FROM asked) AS columns_scanned, (SELECT count(*) FROM asked) - count(*) AS empty_columns, (SELECT count(*) FROM asked WHERE x // 32 = 0 AND z // 32 = 2) AS liquid_unavailable_columns,
  count(*) FILTER (class = 'WATER') AS water_columns, count(*) FILTER (class = 'UNKNOWN') AS unknown_blocks, count(DISTINCT code) FILTER (class = 'UNKNOWN') AS unknown_codes, count(DISTINCT code) AS codes FROM shown""")
def a7(w):
    return surface.surface_diagnostics(w.voxels, resolved(w), w.registry, w.chunk_cov, no_liquids(w))


@plans("a8_climate_summary", f"WITH {INNER} SELECT rx, rz, count(*) AS cells, avg((raw >> 16) & 255) AS temperature, avg((raw >> 8) & 255) AS rain FROM inn WHERE layer = 'climate' GROUP BY rx, rz")
def a8(w):
    return regions.climate_summary(inner(w))


@plans("a9_forest_summary", f"WITH {INNER} SELECT *, {FOREST_SQL.format('(floor(density * 255 + 0.5) / 255.0::DOUBLE)')} AS class FROM (SELECT rx, rz, count(*) AS cells, min(raw) AS low, max(raw) AS high, avg(raw) / 255.0::DOUBLE AS density FROM inn WHERE layer = 'forest' GROUP BY rx, rz)")
def a9(w):
    return regions.forest_summary(inner(w))


@plans("a10_value_summary", f"WITH {INNER} SELECT rx, rz, count(*) AS cells, min(raw) AS low, max(raw) AS high, avg(raw) AS mean FROM inn WHERE layer = 'ocean' GROUP BY rx, rz")
def a10(w):
    return regions.value_summary(inner(w), "ocean")


IDS = f"""{INNER}, ids AS (SELECT layer, rx, rz, raw AS id, count(*) AS cells FROM inn WHERE layer IN ('landform', 'province') GROUP BY ALL),
  tops AS (SELECT *, (sum(cells) OVER r)::BIGINT AS samples, count(*) OVER r AS ids, row_number() OVER (PARTITION BY layer, rx, rz ORDER BY cells DESC, id) AS place FROM ids WINDOW r AS (PARTITION BY layer, rx, rz))"""


def id_summaries(w):
    both = [regions.id_summary(inner(w), layer).select(F.lit(layer).alias("layer"), "*") for layer in regions.ID_LAYERS]
    return both[0].unionByName(both[1])


@plans("a11_id_summary", f"WITH {IDS} SELECT DISTINCT layer, rx, rz, samples, ids FROM tops")
def a11(w):
    return id_summaries(w).select("layer", "rx", "rz", "samples", "ids").distinct()


@plans("a12_signal_dataset", f"WITH {INNER} SELECT substr(layer, 5) AS resource, min(raw) AS low, max(raw) AS high, avg(raw) AS mean, count(DISTINCT raw) AS values, count(DISTINCT (rx, rz)) AS regions FROM inn WHERE layer LIKE 'ore:%' GROUP BY layer")
def a12(w):
    return regions.signal_dataset(inner(w))


@plans("a13_signal_relative", f"WITH {SIGNALS} SELECT rx, rz, lx, lz, raw, res AS resource, relative FROM sig WHERE relative >= 0.25")
def a13(w):
    return regions.signal_relative(inner(w), 0.25).select("rx", "rz", "lx", "lz", "raw", "resource", "relative")


COVER = """cover AS (SELECT min(rx) AS min_rx, max(rx) AS max_rx, min(rz) AS min_rz, max(rz) AS max_rz, count(*) AS present, max(rx) - min(rx) + 1 AS width, max(rz) - min(rz) + 1 AS height,
  ((max(rx) - min(rx) + 1)::BIGINT * (max(rz) - min(rz) + 1)) AS possible FROM regions)"""


@plans("a14_coverage_summary", f"WITH {COVER} SELECT *, possible - present AS missing, present * 100.0::DOUBLE / possible AS percent FROM cover")
def a14(w):
    return regions.coverage_summary(w.regions)


@plans("a15_y_masks", "SELECT x // 32 AS cx, y // 32 AS cy, z // 32 AS cz, block_id, x % 32 AS lx, z % 32 AS lz, bit_or(1::BIGINT << (y % 32)) AS y_mask FROM voxels GROUP BY ALL")
def a15(w):
    return ore.y_masks(w.voxels_by_column())


OBSERVED = f"""{AVAIL}, {HITS.format(v='avail')}, {PLAN}, gap AS (SELECT request_id, bool_or(coalesce(status, '') <> 'AVAILABLE') AS gap FROM plan p LEFT JOIN chunk_cov c ON p.cx = c.cx AND p.cy = c.cy AND p.cz = c.cz GROUP BY request_id),
  obs AS (SELECT r.request_id, r.resource, CASE WHEN EXISTS (SELECT 1 FROM hits h WHERE h.request_id = r.request_id AND h.resource = r.resource) THEN 'OBSERVED' WHEN gap THEN 'UNAVAILABLE' ELSE 'NOT_OBSERVED' END AS observation FROM requests r JOIN gap USING (request_id))"""


@plans("a16_ore_observation", f"WITH {OBSERVED} SELECT * FROM obs")
def a16(w):
    return ore.ore_observation(w.voxels, w.registry, w.requests, w.chunk_cov, w.size)


@plans("a17_max_signal", f"WITH {SIGNALS} SELECT * FROM best")
def a17(w):
    return regions.max_signal(ore_signals(w), w.requests)


CATALOG = f"catalog AS (SELECT CASE WHEN namespace = '' THEN key ELSE namespace || ':' || key END AS object_key, min(namespace) AS namespace, min(key) AS resource_key, list_sort(list(DISTINCT family)) AS families, list_sort(list(DISTINCT block_id)) AS block_ids FROM ({OBJECT_SQL}) GROUP BY 1)"


def used_registry(w):
    return w.registry.join(w.voxels.select("block_id").distinct(), "block_id", "left_semi")


@plans("a18_object_catalog", f"WITH {CATALOG} SELECT object_key, array_to_string(families, ',') AS families, array_to_string(block_ids, ',') AS block_ids FROM catalog")
def a18(w):
    return O.object_catalog(used_registry(w)).select("object_key", F.array_join("families", ",").alias("families"), F.array_join(F.col("block_ids").cast("array<string>"), ",").alias("block_ids"))


NEAR = f"""{AVAIL}, {CATALOG}, near AS (SELECT x, z, y::INT AS y FROM heights, range(0, 128) r(y) WHERE (y >= terrain_y - 2 AND y < terrain_y + 4) OR (y >= rain_y AND y < rain_y + 4)),
  seen AS (SELECT object_key, n.x, n.y, n.z, a.block_id FROM near n JOIN avail a ON n.x = a.x AND n.y = a.y AND n.z = a.z JOIN catalog c ON list_contains(c.block_ids, a.block_id))"""


def observations(w):
    w.keep_voxels()
    return O.object_observations(w.heights, w.voxels, O.object_catalog(used_registry(w)), w.chunk_cov, SIZE_Y)


@plans("a19_object_observations", f"WITH {NEAR} SELECT * FROM seen")
def a19(w):
    return observations(w)


@plans("a20_observed_objects", f"""
WITH {NEAR} SELECT c.object_key, upper(resource_key[1]) || resource_key[2:] || CASE WHEN namespace IN ('', 'game') THEN '' ELSE ' [' || namespace || ']' END AS display,
  array_to_string(list_filter([CASE WHEN list_contains(families, 'ORE_BITS') THEN 'Ore bits' END, CASE WHEN list_contains(families, 'FLINT') THEN 'Flint' END, CASE WHEN list_contains(families, 'LOOSE_STONE') THEN 'Loose stone' END,
    CASE WHEN list_contains(families, 'LOOSE_BOULDER') THEN 'Loose boulder' END], lambda v: v IS NOT NULL), ', ') AS labels, count(*) AS found FROM seen s JOIN catalog c ON s.object_key = c.object_key GROUP BY ALL""")
def a20(w):
    return O.observed_objects(observations(w), O.object_catalog(used_registry(w)))


COMPONENTS = f"""{CLAY}, node AS (SELECT x, z, x::BIGINT * 4294967296 + z AS id FROM clay),
  touch AS (SELECT a.id AS u, b.id AS v FROM node a JOIN node b ON abs(a.x - b.x) <= 1 AND abs(a.z - b.z) <= 1),
  walk AS (SELECT id AS n, id AS r FROM node UNION SELECT touch.v, walk.r FROM walk JOIN touch ON walk.n = touch.u),
  comp AS (SELECT x, z, component FROM (SELECT n, min(r) AS component FROM walk GROUP BY n) c JOIN node ON node.id = c.n)"""


@plans("k1_components8", f"WITH RECURSIVE {COMPONENTS} SELECT * FROM comp")
def k1(w):
    return K.components8(clay_cells(w))


DEPOSITS = f"""{COMPONENTS}, cell AS (SELECT x, z, max(y) AS y, arg_max(block_id, y) AS block_id FROM voxels WHERE block_id IN (22, 23) GROUP BY x, z),
  dep AS (SELECT component, count(*) AS cells, array_to_string(list_sort(list(DISTINCT code)), ',') AS codes, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, avg(x) AS mean_x, avg(z) AS mean_z
    FROM cell JOIN comp USING (x, z) JOIN registry USING (block_id) GROUP BY component)"""


@plans("a21_deposit_stats", f"WITH RECURSIVE {DEPOSITS} SELECT * FROM dep")
def a21(w):
    cells = clay_cells(w).join(small(w.registry), "block_id")
    return K.deposit_stats(cells, K.components8(cells))


@plans("a22_height_range", "SELECT coalesce(min(rain_y), 0) AS low, coalesce(max(rain_y), 0) AS high FROM heights")
def a22(w):
    from ..operators.tiles import height_range

    return height_range(w.heights.select("x", "z", F.col("rain_y").alias("height")))


@plans("a23_ore_block_catalog", "SELECT r.block_id, min(code) AS code, count(*) AS n FROM registry r JOIN voxels v ON v.block_id = r.block_id WHERE regexp_matches(code, '^([^:]*:)?ore-') GROUP BY r.block_id")
def a23(w):
    return ore.ore_block_catalog(w.registry).join(w.voxels.groupBy("block_id").agg(F.count(F.lit(1)).alias("n")), "block_id")


@plans("a24_layer_completeness", f"""
WITH {rock_sql(0, 127)}, {SURFACE.replace(AVAIL + ', ', '')}, m AS (SELECT DISTINCT x // 32 AS mx, z // 32 AS mz FROM voxels)
SELECT layer, done, CASE WHEN bool_and(done) OVER () THEN 'READY' WHEN bool_or(done) OVER () THEN 'PARTIAL' ELSE 'NOT_PREPARED' END AS revision FROM (
  SELECT 'mapchunk_catalog' AS layer, count(*) = 0 AS done FROM m WHERE (mx, mz) NOT IN (SELECT (cx, cz) FROM arrivals)
  UNION ALL SELECT 'terrain', count(*) = 0 FROM asked WHERE (x, z) NOT IN (SELECT (x, z) FROM heights)
  UNION ALL SELECT 'surface', count(*) = 0 FROM asked WHERE (x, z) NOT IN (SELECT (x, z) FROM surf)
  UNION ALL SELECT 'regions', count(*) > 0 FROM regions
  UNION ALL SELECT 'upper_rock', count(*) = 0 FROM rock WHERE state = 'UNAVAILABLE'
  UNION ALL SELECT 'resources', count(*) = 0 FROM chunk_cov WHERE status <> 'AVAILABLE')""")
def a24(w):
    from ..operators.tables import layer_completeness, missing_only

    w.keep_voxels()
    columns = w.voxels.select("x", "z").distinct()
    mapchunks = columns.select(G.to_chunk(F.col("x")).alias("cx"), G.to_chunk(F.col("z")).alias("cz")).distinct()
    return layer_completeness({
        "mapchunk_catalog": missing_only(mapchunks, w.arrivals, ["cx", "cz"]), "terrain": missing_only(columns, w.heights, ["x", "z"]),
        "surface": missing_only(columns, resolved(w), ["x", "z"]), "regions": w.regions.agg(F.count(F.lit(1)).alias("n")).where("n = 0"),
        "upper_rock": upper(w).where("state = 'UNAVAILABLE'"), "resources": w.chunk_cov.where("status <> 'AVAILABLE'")})


@plans("a25_fallback_diagnostics", f"WITH {classed_sql()} SELECT x // 32 AS mx, z // 32 AS mz, count(*) AS considered, count(*) FILTER (g) AS resolved, count(*) FILTER (x // 32 = 0 AND z // 32 = 2) AS liquid_missing FROM (SELECT x, z, bool_or(ground) AS g FROM classed GROUP BY x, z) GROUP BY ALL")
def a25(w):
    w.keep_voxels()
    return surface.fallback_diagnostics(surface.judged(w.voxels, w.liquids, w.registry), no_liquids(w))


@plans("a26_overlay_counts", """
SELECT request_id, count(*) AS considered, count(p.rx) AS drawn, count(*) FILTER (p.rx IS NULL) AS without_data FROM (SELECT DISTINCT request_id, cx, cz FROM requests) r JOIN regions g ON g.rx*512 < cx + 3000 AND g.rx*512 + 512 > cx - 3000 AND g.rz*512 < cz + 3000 AND g.rz*512 + 512 > cz - 3000
LEFT JOIN (SELECT DISTINCT rx, rz FROM layer_cells WHERE layer = 'climate' AND lx BETWEEN 1 AND 16 AND lz BETWEEN 1 AND 16) p ON p.rx = g.rx AND p.rz = g.rz GROUP BY request_id""")
def a26(w):
    asked = w.requests.select("request_id", "cx", "cz", F.lit(3000).alias("radius")).distinct()
    return regions.overlay_counts(w.regions, asked, regions.climate_summary(inner(w)))


# -- ranking and keys


@plans("w1_top8_ids", f"WITH {IDS} SELECT * FROM tops WHERE place <= 8")
def w1(w):
    return id_summaries(w)


@plans("w2_first8_raw", f"WITH {INNER} SELECT rx, rz, array_to_string(list(raw ORDER BY lz, lx)[1:8], ',') AS first_raw FROM inn WHERE layer = 'climate' GROUP BY rx, rz")
def w2(w):
    return regions.first_values(inner(w), "climate").select("rx", "rz", F.array_join(F.col("first_raw").cast("array<string>"), ",").alias("first_raw"))


@plans("w3_top_unknown_codes", f"WITH {SURFACE}, {SHOWN} SELECT code, count(*) AS blocks FROM shown WHERE class = 'UNKNOWN' GROUP BY 1 ORDER BY blocks DESC, code LIMIT 3")
def w3(w):
    return surface.unknown_codes(resolved(w), w.registry, 3)


ORDERED = f"{DEPOSITS}, ordered AS (SELECT *, row_number() OVER (ORDER BY cells DESC, mean_x, mean_z, component) AS place, row_number() OVER (ORDER BY cells DESC, mean_x, mean_z, component) <= 20 AS marked, CASE WHEN cells >= 100 THEN 'LARGE' WHEN cells >= 25 THEN 'MEDIUM' ELSE 'SMALL' END AS band FROM dep)"


@plans("w4_deposit_order", f"WITH RECURSIVE {ORDERED} SELECT place, component, cells, marked, band FROM ordered")
def w4(w):
    return K.deposit_order(a21(w)).select("place", "component", "cells", "marked", "band")


@plans("w6_resource_keys", f"WITH {INNER} SELECT DISTINCT substr(layer, 5) AS resource FROM inn WHERE layer LIKE 'ore:%'")
def w6(w):
    return regions.resource_keys(inner(w))


@plans("w7_default_player", "SELECT min(c_name || '/' || c_custkey) AS record FROM customer")
def w7(w):
    return decode.default_player(players(w)).select("record")


@plans("u1_distinct_coords", "SELECT DISTINCT cx, cy, cz FROM arrivals")
def u1(w):
    return w.arrivals.dropDuplicates(CK).select(*CK)


@plans("u2_union_ids", f"WITH {MEMBER}, {ROCKS} SELECT block_id, count(*) AS n FROM voxels WHERE block_id IN (SELECT block_id FROM member UNION SELECT block_id FROM rocks) GROUP BY block_id")
def u2(w):
    ids = rock.rocks(w.registry).select("block_id").union(ore.membership(w.registry, w.requests).select("block_id")).distinct()
    return w.voxels.join(small(ids), "block_id", "left_semi").groupBy("block_id").agg(F.count(F.lit(1)).alias("n"))


@plans("u3_refresh_merge", "SELECT cx, cy, cz, status, false AS rebuilt FROM chunk_cov WHERE status = 'AVAILABLE' UNION ALL SELECT cx, cy, cz, 'AVAILABLE', true FROM chunk_cov WHERE status <> 'AVAILABLE'")
def u3(w):
    from ..operators.tables import refresh_merge

    rebuilt = w.chunk_cov.where("status <> 'AVAILABLE'").withColumn("status", F.lit("AVAILABLE"))
    return refresh_merge(w.chunk_cov.where("status = 'AVAILABLE'"), rebuilt)


@plans("u4_batch_buckets", "SELECT floor(x / 512)::INT AS rx, floor(z / 512)::INT AS rz, count(DISTINCT (floor(x / 32), floor(z / 32))) AS mapchunks FROM (SELECT o_orderkey % 9000 - 4500 AS x, o_custkey * 7 % 9000 - 4500 AS z FROM orders) GROUP BY ALL")
def u4(w):
    at = w.table("orders").selectExpr("o_orderkey % 9000 - 4500 AS x", "o_custkey * 7 % 9000 - 4500 AS z").select(G.to_chunk(F.col("x")).alias("mx"), G.to_chunk(F.col("z")).alias("mz")).distinct()
    return at.groupBy(G.to_region(F.col("mx")).alias("rx"), G.to_region(F.col("mz")).alias("rz")).agg(F.count(F.lit(1)).alias("mapchunks"))


@plans("u5_duplicate_check", """
SELECT 'REJECTED' AS rule, cx, cy, cz, count(*) AS n, NULL::BIGINT AS kept, NULL AS status FROM arrivals GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'FIRST_KEPT', cx, cy, cz, count(*), min(event_id), arg_min(status, event_id) FROM arrivals GROUP BY ALL""")
def u5(w):
    from ..operators.tables import duplicates, first_kept

    rejected = duplicates(w.arrivals, CK).select(F.lit("REJECTED").alias("rule"), *CK, "n", F.lit(None).cast("long").alias("kept"), F.lit(None).cast("string").alias("status"))
    kept = first_kept(w.arrivals.select(*CK, "event_id", "status"), CK, ["event_id"])
    return rejected.unionByName(kept.select(F.lit("FIRST_KEPT").alias("rule"), *CK, (F.col("repeats") + 1).alias("n"), F.col("event_id").alias("kept"), "status"))


@plans("u6_key_runs", "SELECT min(k) AS first_key, max(k) AS last_key, count(*) AS n FROM (SELECT k, k - row_number() OVER (ORDER BY k) AS g FROM (SELECT DISTINCT l_partkey * 3 // 4 + l_suppkey AS k FROM lineitem)) GROUP BY g")
def u6(w):
    return regions.key_runs(w.table("lineitem").select(F.expr("l_partkey * 3 div 4 + l_suppkey").alias("k")), "k")


# -- composite jobs


@plans("p1_ore_map", f"WITH {COLUMNS.format(v='voxels')} SELECT * FROM cols")
def p1(w):
    return ore.ore_map(ore.chunk_table(w.voxels), w.registry, w.requests, w.size)


@plans("p2_ore_map_indexed", f"""
WITH {COLUMNS.format(v='voxels')}, {PLAN}, ok AS (SELECT request_id FROM plan p LEFT JOIN indexed_cov c
  ON p.cx = c.cx AND p.cy = c.cy AND p.cz = c.cz GROUP BY request_id HAVING bool_and(status IS NOT NULL))
SELECT * FROM cols WHERE request_id IN (SELECT request_id FROM ok)""")
def p2(w):
    return ore.ore_map_indexed(ore.y_masks(w.voxels_by_column()), w.indexed_cov, w.registry, w.requests, w.size)


@plans("p3_rock_map", f"WITH {rock_sql(0, 127)}, {LEGEND} SELECT rock.*, legend.percent FROM rock LEFT JOIN legend ON rock.rock_code = legend.rock_code")
def p3(w):
    columns = upper(w)
    return columns.join(rock.rock_legend(columns).select("rock_code", "percent"), "rock_code", "left").select("x", "z", "state", "rock_id", "rock_code", "y", "percent")


@plans("p4_resolve_surface", f"WITH {SURFACE} SELECT * FROM surf")
def p4(w):
    return resolved(w)


P5 = f"""{SURFACE}, clay AS (SELECT x, z, y, code FROM surf JOIN registry USING (block_id) WHERE contains(code, 'clay') OR contains(code, 'soil')),
  node AS (SELECT x, z, x::BIGINT * 4294967296 + z AS id FROM clay WHERE code LIKE '%soil%'),
  touch AS (SELECT a.id AS u, b.id AS v FROM node a JOIN node b ON abs(a.x - b.x) <= 1 AND abs(a.z - b.z) <= 1),
  walk AS (SELECT id AS n, id AS r FROM node UNION SELECT touch.v, walk.r FROM walk JOIN touch ON walk.n = touch.u),
  comp AS (SELECT x, z, component FROM (SELECT n, min(r) AS component FROM walk GROUP BY n) c JOIN node ON node.id = c.n),
  dep AS (SELECT component, count(*) AS cells, array_to_string(list_sort(list(DISTINCT code)), ',') AS codes, avg(x) AS mean_x, avg(z) AS mean_z FROM clay JOIN comp USING (x, z) GROUP BY component)"""


@plans("p5_material_deposits", f"WITH RECURSIVE {P5} SELECT component, cells, codes, mean_x, mean_z, row_number() OVER (ORDER BY cells DESC, mean_x, mean_z, component) AS place FROM dep")
def p5(w):
    from ..operators.graph import store

    surf, _ = store(resolved(w), "surface")
    return K.material_deposits(surf, w.registry, ["soil"]).select("component", "cells", "codes", "mean_x", "mean_z", "place")


@plans("p6_discover_objects", f"""
WITH {NEAR}, gaps AS (SELECT n.x, n.z, bool_or(coalesce(status, '') <> 'AVAILABLE') AS gap FROM near n LEFT JOIN chunk_cov c ON c.cx = n.x // 32 AND c.cy = n.y // 32 AND c.cz = n.z // 32 GROUP BY ALL)
SELECT CASE WHEN h.x IS NOT NULL THEN 'OBSERVED' WHEN gap THEN 'UNAVAILABLE' ELSE 'NOT_OBSERVED' END AS state, count(*) AS columns FROM gaps g LEFT JOIN (SELECT DISTINCT x, z FROM seen) h ON g.x = h.x AND g.z = h.z GROUP BY 1""")
def p6(w):
    return O.column_states(w.heights, observations(w), w.chunk_cov, SIZE_Y)


SOILMAP = f"""{SURFACE}, soil AS (SELECT x, z, {SOIL_SQL} AS tier FROM (SELECT surf.*, {PATH_SQL} AS p FROM surf JOIN registry USING (block_id)) WHERE class NOT IN ('WATER', 'SNOW'))"""


@plans("p7_soil_map", f"WITH {SOILMAP} SELECT x, z, tier, CASE tier WHEN 'BONY' THEN 0 WHEN 'BARREN' THEN 5 WHEN 'LOW' THEN 25 WHEN 'MEDIUM' THEN 50 WHEN 'HIGH' THEN 65 ELSE 80 END AS percent FROM soil WHERE tier IS NOT NULL")
def p7(w):
    return surface.soil_map(resolved(w), w.registry)


def id_layer_sql(layer):
    """CTEs: ids of a layer by place, and their number and top 8 per region."""
    return f"""{layer}_ids AS (SELECT rx, rz, raw AS id, count(*) AS n, row_number() OVER (PARTITION BY rx, rz ORDER BY count(*) DESC, raw) AS place FROM inn WHERE layer = '{layer}' GROUP BY rx, rz, raw),
  {layer}s AS (SELECT rx, rz, sum(n)::BIGINT AS {layer}_cells, count(*) AS {layer}_ids, list(id ORDER BY place) FILTER (place <= 8) AS {layer}_top FROM {layer}_ids GROUP BY rx, rz)"""


PROFILES = f"""{INNER}, cl AS (SELECT rx, rz, count(*) AS climate_cells, avg((raw >> 16) & 255) AS t, avg((raw >> 8) & 255) AS r FROM inn WHERE layer = 'climate' GROUP BY rx, rz),
  fo AS (SELECT rx, rz, count(*) AS forest_cells, avg(raw) / 255.0::DOUBLE AS d FROM inn WHERE layer = 'forest' GROUP BY rx, rz),
  oc AS (SELECT rx, rz, count(*) AS ocean_cells, min(raw) AS ocean_low, max(raw) AS ocean_high, avg(raw) AS ocean_mean FROM inn WHERE layer = 'ocean' GROUP BY rx, rz),
  {id_layer_sql("landform")}, {id_layer_sql("province")},
  prof AS (SELECT * FROM (SELECT DISTINCT rx, rz FROM inn WHERE layer NOT LIKE 'ore:%') k LEFT JOIN cl USING (rx, rz) LEFT JOIN fo USING (rx, rz) LEFT JOIN oc USING (rx, rz) LEFT JOIN landforms USING (rx, rz) LEFT JOIN provinces USING (rx, rz))"""

PROFILE = ["ocean_cells", "ocean_low", "ocean_high", "ocean_mean", "landform_cells", "landform_ids", "province_cells", "province_ids"]


@plans("p8_environment_profiles", f"WITH {PROFILES} SELECT rx, rz, climate_cells, t AS temperature, r AS rain, forest_cells, d AS density, CASE WHEN d IS NOT NULL THEN {FOREST_SQL.format('(floor(d * 255 + 0.5) / 255.0::DOUBLE)')} END AS forest_class, array_to_string({LABELS_SQL}, ',') AS labels, {', '.join(PROFILE)}, array_to_string(landform_top, ',') AS landforms, array_to_string(province_top, ',') AS provinces FROM prof")
def p8(w):
    p = regions.environment_profiles(inner(w))
    ids = [F.array_join(F.col(f"{layer}_top").cast("array<string>"), ",").alias(f"{layer}s") for layer in regions.ID_LAYERS]
    return p.select("rx", "rz", "climate_cells", "temperature", "rain", "forest_cells", "density", "forest_class", F.array_join("labels", ",").alias("labels"), *PROFILE, *ids)


@plans("p9_region_coverage", """
WITH p AS (SELECT min(rx) AS a, max(rx) AS b, min(rz) AS c, max(rz) AS d FROM regions)
SELECT rx::INT AS rx, rz::INT AS rz, (rx, rz) IN (SELECT (rx, rz) FROM regions) AS present, (rx*512)::INT AS x0, (rz*512)::INT AS z0, (rx*512+512)::INT AS x1, (rz*512+512)::INT AS z1, rx*512 - 48.0::DOUBLE * scale AS display_x0, rz*512 - 48.0::DOUBLE AS display_z0
FROM p, extent, (SELECT unnest(range(a, b + 1)) AS rx FROM p) x, (SELECT unnest(range(c, d + 1)) AS rz FROM p) z WHERE rx BETWEEN a AND b AND rz BETWEEN c AND d""")
def p9(w):
    return regions.coverage_cells(w.regions, w.size[0], SIZE_Z)


EVIDENCE = f"""{rock_sql(0, 127)}, {HOST_PAIRS}, {COMPAT_SQL}, {OBSERVED.replace(AVAIL + ', ', '')}, {SIGNALS},
  geo AS (SELECT request_id, count(*) FILTER (state = 'OBSERVED') AS observed, count(*) FILTER (state = 'NO_ROCK') AS no_rock, count(*) FILTER (state = 'UNAVAILABLE') AS unavailable FROM cells JOIN rock ON cells.x = rock.x AND cells.z = rock.z GROUP BY request_id),
  ev AS (SELECT o.request_id, o.resource, observation, signal, coalesce(compatibility, 'UNKNOWN') AS compatibility, observed, no_rock, unavailable, CASE WHEN observed > 0 THEN 'OBSERVED' WHEN unavailable > 0 THEN 'UNAVAILABLE' ELSE 'NO_ROCK' END AS geology
    FROM obs o JOIN best b ON o.request_id = b.request_id AND o.resource = b.resource LEFT JOIN hosts h ON o.request_id = h.request_id AND o.resource = h.resource LEFT JOIN geo g ON g.request_id = o.request_id),
  ranked AS (SELECT *, CASE WHEN observation = 'OBSERVED' THEN 'CONFIRMED' WHEN geology = 'UNAVAILABLE' THEN 'UNKNOWN' WHEN signal > 0 AND compatibility = 'COMPATIBLE' THEN 'STRONG' WHEN signal > 0 AND compatibility = 'INCOMPATIBLE' THEN 'WEAK'
    WHEN signal > 0 OR compatibility = 'COMPATIBLE' THEN 'INTERESTING' ELSE 'UNKNOWN' END AS rank FROM ev)"""


REASONS = """array_to_string(list_filter([
  CASE WHEN observation = 'OBSERVED' THEN 'actual saved ore block observed' WHEN geology = 'UNAVAILABLE' THEN 'observed geology is unavailable'
    WHEN signal > 0 AND compatibility = 'COMPATIBLE' THEN 'positive worldgen signal has compatible observed geology' WHEN signal > 0 AND compatibility = 'INCOMPATIBLE' THEN 'positive worldgen signal has incompatible observed geology'
    WHEN signal > 0 THEN 'positive worldgen signal is present' WHEN compatibility = 'COMPATIBLE' THEN 'compatible observed geology is present' ELSE 'no positive supporting evidence is available' END,
  coalesce('worldgen signal=' || signal::VARCHAR, 'worldgen signal unavailable'), 'observed geology=' || geology, 'geology coverage: observed=' || observed || ', no-rock=' || no_rock || ', unavailable=' || unavailable,
  CASE WHEN unavailable > 0 AND observed + no_rock > 0 THEN 'observed geology coverage is partial' END, 'host compatibility=' || compatibility,
  CASE observation WHEN 'NOT_OBSERVED' THEN 'actual ore scan completed without an observation' WHEN 'UNAVAILABLE' THEN 'actual ore observation is unavailable' END], lambda v: v IS NOT NULL), '; ')"""


@plans("p10_prospecting", f"WITH {EVIDENCE} SELECT request_id, resource, observation, signal, compatibility, geology, observed, no_rock, unavailable, rank, {REASONS} AS reasons FROM ranked")
def p10(w):
    w.keep_voxels()
    out = prospecting.prospecting(w.requests, w.voxels, w.registry, w.chunk_cov, ore_signals(w), w.compat, w.size)
    return out.select("request_id", "resource", "observation", "signal", "compatibility", "geology", "observed", "no_rock", "unavailable", "rank", F.array_join("reasons", "; ").alias("reasons"))


@plans("w5_assessment_order", f"WITH {EVIDENCE} SELECT request_id, resource, rank, row_number() OVER (PARTITION BY request_id ORDER BY list_position(['CONFIRMED', 'STRONG', 'INTERESTING', 'WEAK', 'UNKNOWN'], rank), resource) AS place FROM ranked")
def w5(w):
    w.keep_voxels()
    return prospecting.prospecting(w.requests, w.voxels, w.registry, w.chunk_cov, ore_signals(w), w.compat, w.size).select("request_id", "resource", "rank", "place")


@plans("p11_world_overview", f"WITH {INNER}, header AS ({HEADER}) SELECT header.*, (SELECT array_to_string(list_sort(list(DISTINCT substr(layer, 5))), ',') FROM inn WHERE layer LIKE 'ore:%') AS keys FROM header")
def p11(w):
    keys = regions.resource_keys(inner(w)).agg(F.array_join(F.array_sort(F.collect_set("resource")), ",").alias("keys"))
    return world_header(w).join(F.broadcast(keys))  # one row each


PROBES = "SELECT c_custkey, CAST(c_custkey % (96 * :scale + 14) AS INT) AS x, CAST(c_custkey * 7 % 110 AS INT) AS z FROM {customer}"


@plans("p17_probe_cell", f"WITH {rock_sql(0, 127)}, {SURFACE.replace(AVAIL + ', ', '')} SELECT c_custkey, p.x, p.z, s.y AS surface_y, s.block_id AS surface_block, s.class, rock.state AS rock_state, rock.rock_code FROM ({for_oracle(PROBES)}) p LEFT JOIN surf s ON p.x = s.x AND p.z = s.z LEFT JOIN rock ON rock.x = p.x AND rock.z = p.z")
def p17(w):
    return surface.probe(w.sql(PROBES), resolved(w), upper(w)).select("c_custkey", "x", "z", "surface_y", "surface_block", "class", "rock_state", "rock_code")
