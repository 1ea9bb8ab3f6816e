"""Pyramids, rasters, stored short forms and region profiles."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loam.functions import geometry as G
from loam.operators import regions, tiles
from loam.operators.tables import stored_columns, stored_legend, stored_pixels
from loam.sources import tables as T


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def heights(spark):
    rnd = random.Random(2)
    return spark.createDataFrame([(x, z, rnd.randrange(100)) for x in range(160) for z in range(96) if not (70 < x < 75)], "x int, z int, height int").cache()


def test_stencil_asks_for_what_pixels_sample(spark, heights):
    at = {(r.x, r.z): r.height for r in heights.collect()}
    bounds = spark.createDataFrame([(0, 0, 0, 64, 0, 64), (1, 0, 64, 128, 0, 64), (2, 1, 128, 150, 64, 96)], "tx int, tz int, x0 int, x1 int, z0 int, z1 int")
    sizes = []
    for lod in range(6):
        step, pixels = 1 << lod, tiles.sample_grid(bounds, lod)
        got = tiles.stencil(pixels, heights).collect()
        assert len(got) == pixels.count() == sum(math.ceil((b - a) / step) * math.ceil((d - c) / step) for a, b, c, d in ((0, 64, 0, 64), (64, 128, 0, 64), (128, 150, 64, 96)))
        for r in got:
            assert (r.height, r.west, r.east, r.north, r.south) == tuple(at.get(k) for k in ((r.x, r.z), (r.x - step, r.z), (r.x + step, r.z), (r.x, r.z - step), (r.x, r.z + step)))
        sizes.append(len(got))
    assert all(b <= a / 4 + 60 for a, b in zip(sizes, sizes[1:]))  # a level costs a quarter of the one below


def test_coarse_levels_keep_the_bounds_and_a_missing_neighbour_shades_nothing(spark, heights):
    bounds = spark.createDataFrame([(0, 0, 0, 64, 0, 64)], "tx int, tz int, x0 int, x1 int, z0 int, z1 int")
    none = spark.createDataFrame([], "x int, z int, class string"), spark.createDataFrame([], "x int, z int, tier string")
    got = tiles.tile_pyramid(bounds, heights, *none).groupBy("lod").agg(F.max("px"), F.max("pz"), F.count(F.lit(1))).collect()
    assert sorted(tuple(r) for r in got) == [(k, 64 // (1 << k) - 1, 64 // (1 << k) - 1, (64 // (1 << k)) ** 2) for k in range(6)]
    from loam.functions import colours as P

    edge = spark.createDataFrame([(1, None, 5, 5), (1, 90, 5, 5)], "w int, e int, n int, s int").select(P.hillshade(*(F.col(c) for c in "wens")).alias("v"))
    assert [r.v for r in edge.collect()] == [0.0, -0.35]


def test_request_and_rock_rasters(spark, heights):
    at = {(r.x, r.z): r.height for r in heights.collect()}
    asked = [(1, 20, 30, 5, 1), (2, 71, 40, 40, 2), (3, 0, 0, 12, 3), (4, 500, 500, 3, 1), (5, 90, 50, 0, 1)]
    requests = spark.createDataFrame(asked, "id int, cx int, cz int, radius int, pixels_per_block int")

    def brute(width, raster, offset):
        out = []
        for i, cx, cz, r, ppb in asked:
            for px in range(raster(r, ppb)) if r else ():
                for pz in range(raster(r, ppb)):
                    x, z = (c - r + min(width(r) - 1, offset(p, width(r), raster(r, ppb))) for c, p in ((cx, px), (cz, pz)))
                    if (x, z) in at:
                        out.append((i, px, pz, x, z, at[x, z]))
        return sorted(out, key=repr)

    got = tiles.raster_samples(heights, tiles.request_axes(requests), "id")
    assert rows(got) == brute(lambda r: 2 * r, lambda r, p: min(max(2 * r * p + 1, 64), 4096), lambda p, w, n: math.floor(p / (n / w)))
    for most in (4096, 16, 7):
        got = tiles.raster_samples(heights, tiles.rock_axes(requests, most), "id")
        assert rows(got) == brute(lambda r: 2 * r + 1, lambda r, p: min(2 * r + 1, most), lambda p, w, n: math.floor((p + 0.5) * w / n))
    # one to one, every cell has its pixel
    one = tiles.rock_axes(requests.where("id = 1")).select(F.explode("axis").alias("a")).select("a.*")
    assert rows(one) == sorted(((i, i) for i in range(11)), key=repr)


def stored_of(spark, tmp_path, column):
    rnd = random.Random(4)
    cells = [(x, z, 1100, 600, rnd.choice("abc")) for x in range(0, 1100, 1) for z in range(0, 60)] + [(x, z, 1100, 600, "d") for x in range(500, 530) for z in range(60, 600)]
    path = str(tmp_path / "stored")
    T.publish(T.with_region(spark.createDataFrame(cells, f"x int, z int, size_x int, size_z int, {column} string")), path, ["rx", "rz"])
    return spark.read.parquet(path)


def test_stored_reads_prune_regions_and_short_forms_agree(spark, tmp_path):
    stored = stored_of(spark, tmp_path, "class")
    circles = spark.createDataFrame([(1, 30, 30, 20, 2), (2, 40, 50, 20, 1), (3, 5, 5, 9, 1), (4, 600, 20, 10, 3)], "circle int, cx int, cz int, radius int, pixels_per_block int")
    whole = stored_columns(stored, circles, 1100, 600)
    assert {(r.circle, r.served) for r in whole.select("circle", "served").distinct().collect()} == {(1, True), (2, False), (3, False), (4, True)}
    for read in (whole, stored_pixels(stored, circles, 1100, 600)):
        read.collect()
        plan = read._jdf.queryExecution().toString()
        assert "dynamicpruning" in plan and "PartitionFilters: [isnotnull(rx" in plan
    # pixels of the columns that stored_columns() gives
    want = {}
    for r in sorted(whole.where("served").collect(), key=lambda r: (r.z // 32, r.x // 32, r.z, r.x)):
        cx, cz, radius, ppb = {1: (30, 30, 20, 2), 4: (600, 20, 10, 3)}[r.circle]
        raster = min(max(2 * radius * ppb + 1, 64), 4096)
        scale = raster / (2 * radius)
        for px in range(max(0, math.floor((r.x - cx + radius) * scale)), min(raster, math.ceil((r.x + 1 - cx + radius) * scale))):
            for pz in range(max(0, math.floor((r.z - cz + radius) * scale)), min(raster, math.ceil((r.z + 1 - cz + radius) * scale))):
                want[r.circle, px, pz] = r["class"]
    got = stored_pixels(stored, circles, 1100, 600).collect()
    assert {(r.circle, r.px, r.pz): r["class"] for r in got if r.served} == want
    assert sorted(r.circle for r in got if not r.served) == [2, 3]
    rock = stored.withColumns({"state": F.lit("OBSERVED"), "rock_code": F.col("class")})
    legend = rows(stored_legend(rock, circles, 1100, 600).where("served").select("circle", "state", "rock_code", "columns"))
    assert legend == rows(stored_columns(rock, circles, 1100, 600).where("served").groupBy("circle", "state", "rock_code").count())


def test_odd_circles_are_served_as_their_cells_say(spark, tmp_path):
    """Against a plain loop: holes, columns stored twice, other sizes, edges, repeated and absent circles."""
    rnd = random.Random(9)
    cells = [(x, z, 560, 70, rnd.choice("ab")) for x in range(490, 540) for z in range(70) if (x, z) != (495, 40)]
    cells += [(530, 60, 560, 70, "c"), (500, 10, 560, 99, "d"), (520, 5, None, 70, "e")]
    T.publish(T.with_region(spark.createDataFrame(cells, "x int, z int, size_x int, size_z int, class string")), str(tmp_path / "s"), ["rx", "rz"])
    asked = [(i, rnd.randrange(488, 542), rnd.randrange(-2, 72), rnd.randrange(-2, 14)) for i in range(150)]
    asked += [(150, 512, 65, 4), (150, 520, 30, 8), (151, 515, 30, 9), (151, 515, 30, 9), (152, 515, 30, 9), (152, 496, 40, 2), (153, 530, 60, 9), (154, None, 5, 1), (155, 5, 5, -1)]
    circles = spark.createDataFrame(asked, "circle int, cx int, cz int, radius int")
    at, served, want = {}, {}, []
    for x, z, sx, sz, c in cells:
        at.setdefault((x, z), []).append((sx == 560 and sz == 70, c))
    disc = lambda cx, cz, r: [(x, z) for x in range(cx - r, cx + r + 1) for z in range(cz - r, cz + r + 1) if (x - cx) ** 2 + (z - cz) ** 2 <= r * r]
    for i, cx, cz, r in asked:
        if cx is not None:
            ok = r >= 0 and all(0 <= x < 560 and 0 <= z < 70 and (x, z) in at and all(f for f, _ in at[x, z]) for x, z in disc(cx, cz, r))
            served[i] = served.get(i, True) and ok
    for i, cx, cz, r in asked:
        if served.get(i):
            want += [(i, x, z, c, True) for x, z in disc(cx, cz, r) for _, c in at[x, z]]
    want += [(i, None, None, None, False) for i, ok in served.items() if not ok]
    got = stored_columns(spark.read.parquet(str(tmp_path / "s")), circles, 560, 70).select("circle", "x", "z", "class", "served")
    assert rows(got) == sorted(want, key=repr) and 20 < sum(served.values()) < len(served) - 20 and served[153]


def test_region_profiles_in_one_pass(spark):
    cells = [(0, 0, "climate", 100 << 16 | 200 << 8), (0, 0, "climate", 102 << 16 | 202 << 8), (0, 0, "forest", 300), (0, 0, "forest", 0), (0, 0, "ocean", 7), (0, 0, "ocean", 9)]
    cells += [(0, 0, "landform", i) for i in range(12)] + [(0, 0, "landform", 11)] + [(0, 0, "province", -5), (1, 0, "province", 3), (2, 0, "ore:x", 4), (3, 0, "ocean", 0)]
    got = {r.rx: r for r in regions.environment_profiles(spark.createDataFrame(cells, "rx int, rz int, layer string, raw int")).collect()}
    a = got[0]
    assert set(got) == {0, 1, 3} and (a.climate_cells, a.temperature, a.rain, a.forest_cells, a.density, a.forest_class) == (2, 101.0, 201.0, 2, 0.5, "MODERATE")
    assert (a.ocean_cells, a.ocean_low, a.ocean_high, a.ocean_mean, a.landform_cells, a.landform_ids, a.landform_top, a.province_top) == (2, 7, 9, 8.0, 13, 12, [11, 0, 1, 2, 3, 4, 5, 6], [-5])
    b = got[1]
    assert (b.climate_cells, b.forest_class, b.ocean_mean, b.landform_ids, b.landform_top, b.province_top, b.labels) == (None, None, None, None, None, [3], [])


def test_large_grids_are_made_by_many_tasks(spark):
    far = spark.createDataFrame([(-40, 0), (90, 60)], "rx int, rz int")
    cells = regions.coverage_cells(far, 512, 512)
    assert cells.count() == 131 * 61 and cells.where("present").count() == 2
    circle = G.circle_cells(spark.createDataFrame([(1, 0, 0, 300)], "circle int, cx int, cz int, radius int"))
    parts = circle.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) > 1 and sum(r["count"] for r in parts) == sum(1 for x in range(-300, 301) for z in range(-300, 301) if x * x + z * z <= 90000)
