"""Tables that grow with the world are joined by shuffle, however small their files are."""

import random
import re

import pytest

from loam.operators import surface, tables, tiles
from loam.operators.dims import is_small
from loam.sources import bucketed


def broadcast_joins(df, kind):
    """Joins of that kind that send a side of (x, z) rows through the driver."""
    return re.findall(rf"BroadcastHashJoin \[[^\]]*\bx#[^\]]*\], \[[^\]]*\], {kind}.*", df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture(scope="module")
def columns(spark, tmp_path_factory):
    """A stored table of columns whose file is far below the broadcast threshold."""
    path = str(tmp_path_factory.mktemp("stored") / "columns")
    rows = spark.range(64 * 64).selectExpr("CAST(id % 64 AS INT) x", "CAST(id DIV 64 AS INT) z", "0 rx", "0 rz", "64 size_x", "64 size_z", "'OBSERVED' state", "'rock' rock_code", "'SAND' class", "5 height", "'LOW' tier")
    rows.write.partitionBy("rx", "rz").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def circles(spark):
    return spark.createDataFrame([(1, 30, 30, 20), (2, 0, 0, 5)], "circle int, cx int, cz int, radius int")


def test_stored_legend_does_not_broadcast_the_store(columns, circles):
    found = tables.stored_legend(columns, circles, 64, 64)
    assert not broadcast_joins(found, "LeftOuter")
    assert sorted((r.circle, r.served, r["columns"]) for r in found.collect()) == [(1, True, 1257), (2, False, None)]


def test_stored_columns_does_not_broadcast_the_store(columns, circles):
    found = tables.stored_columns(columns, circles, 64, 64)
    assert not broadcast_joins(found, "LeftOuter")
    assert found.where("served").count() == 1257


def world(spark):
    rnd = random.Random(3)
    codes = ["game:air", "game:rock-granite", "game:soil-medium-normal", "game:leaves-grown-oak", "game:water-still-7", "game:waterfern-tallplant"]
    registry = spark.createDataFrame(list(enumerate(codes)), "block_id int, code string")
    cells = {(rnd.randrange(96), rnd.randrange(64), rnd.randrange(64)): rnd.randrange(6) for _ in range(6000)}
    voxels = spark.createDataFrame([(*k, v) for k, v in cells.items()], "x int, y int, z int, block_id int")
    liquids = spark.createDataFrame([(*k, 4) for k in cells if k[0] % 3 == 0], "x int, y int, z int, liquid_id int")
    top = {}
    for x, y, z in cells:
        top[x, z] = max(top.get((x, z), 0), y)
    heights = spark.createDataFrame([(x, z, y) for (x, z), y in top.items()], "x int, z int, rain_y int")
    coverage = spark.createDataFrame([(cx, cy, cz, "AVAILABLE") for cx in range(3) for cy in range(2) for cz in range(2)], "cx int, cy int, cz int, status string")
    return registry, cells, voxels, liquids, heights, coverage, spark.createDataFrame([(1, 1)], "mx int, mz int")


def test_surface_over_buckets_does_not_broadcast_tables(spark, tmp_path):
    registry, _, voxels, liquids, heights, coverage, dry = world(spark)
    kept = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    try:
        bucketed.co_located(spark)
        v, h, q, c = (bucketed.write(df, str(tmp_path / n), 2) for n, df in (("v", voxels), ("h", heights), ("q", liquids), ("c", coverage)))
        plans, real = [], surface.store
        surface.store = lambda df, name: (plans.append(df), real(df, name))[1]
        try:
            plans.append(surface.resolve_surface(v.select("cx", "cz", "x", "z"), h, v, registry, q, c, dry, 64))
        finally:
            surface.store = real
        for df in plans:
            assert not broadcast_joins(df, r"\w+")
    finally:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", kept)


def test_tile_pyramid_does_not_broadcast_columns(spark, columns):
    bounds = spark.createDataFrame([(0, 0, 0, 64, 0, 64)], "tx int, tz int, x0 int, x1 int, z0 int, z1 int")
    found = tiles.tile_pyramid(bounds, columns.select("x", "z", "height"), columns.select("x", "z", "class"), columns.select("x", "z", "tier"))
    assert not broadcast_joins(found, r"\w+")
    assert found.where("lod = 0").count() == 64 * 64


def test_files_are_counted_before_they_are_called_small(spark, tmp_path):
    spark.range(300_000).selectExpr("CAST(0 AS INT) x").write.parquet(str(tmp_path / "rows"))
    assert not is_small(spark.read.parquet(str(tmp_path / "rows")))


def test_surface_is_one_job_and_counts_water_plants(spark, monkeypatch):
    """Against a plain loop; a foliage block whose code names water is a surface without a liquid too."""
    registry, cells, voxels, liquids, heights, coverage, dry = world(spark)
    monkeypatch.setattr(surface, "store", lambda *_: pytest.fail("the surface is stored on its way"))
    found = {(r.x, r.z): (r.path, r.y, r.block_id, r.liquid_id) for r in surface.resolve_surface(voxels.select("x", "z"), heights, voxels, registry, liquids, coverage, dry, 64).collect()}
    solid, want, bad = {1, 2, 4, 5}, {}, {(1, 1)}
    wet = lambda x, z: x % 3 == 0 and (x // 32, z // 32) != (1, 1)
    tops = {}
    for (x, y, z), b in cells.items():
        tops[x, z] = max(tops.get((x, z), (-1, 0)), (y, b))
        if b in solid or wet(x, z):
            want[x, z] = max(want.get((x, z), (-1, 0)), (y, b))
    for (x, z), (_, b) in tops.items():
        if not (b in solid or x % 3 == 0):
            bad.add((x // 32, z // 32))
    assert found == {(x, z): ("FALLBACK" if (x // 32, z // 32) in bad else "FAST", y, b, 4 if wet(x, z) else 0) for (x, z), (y, b) in want.items()}


def test_voxels_ask_for_their_columns(spark):
    """Without asked columns the surface is that of all columns with a voxel, of which no pass of its own is made."""
    registry, _, voxels, liquids, heights, coverage, dry = world(spark)
    closed = coverage.selectExpr("cx", "cy", "cz", "IF(cx = 2 AND (cz = 1 OR cy = 0), 'FAILED', status) AS status")
    for cover in (coverage, closed, closed.where("cx < 2 OR cy = 0")):
        found = [surface.resolve_surface(c, heights, voxels, registry, liquids, cover, dry, 64) for c in (None, voxels.select("x", "z"))]
        rows = [sorted(tuple(r) for r in df.collect()) for df in found]
        assert rows[0] == rows[1] and len(rows[0]) > 1000
        assert len(re.findall("Exchange ", found[0]._jdf.queryExecution().executedPlan().toString())) < len(re.findall("Exchange ", found[1]._jdf.queryExecution().executedPlan().toString()))


def test_cells_of_circles_are_joined_once(columns, circles, monkeypatch):
    """What is served and what it gives come from one join."""
    kept = []
    real = tables.store
    monkeypatch.setattr(tables, "store", lambda df, name: (kept.append(df), real(df, name))[1])
    found = tables.stored_pixels(columns, circles.selectExpr("*", "CAST(1.5 AS DOUBLE) AS pixels_per_block"), 64, 64)
    assert len(kept) == 1 and "x#" not in "".join(re.findall(r"SortMergeJoin .*", found._jdf.queryExecution().executedPlan().toString()))
    assert sorted({(r.circle, r.served) for r in found.collect()}) == [(1, True), (2, False)]


def test_cells_of_circles_are_not_broadcast(spark):
    """Spark takes the cells of circles for as few rows as there are requests."""
    from loam.plans.worlds import request_rock
    from loam.plans.worldviews import World

    assert not broadcast_joins(request_rock(World(spark, "/root/testdata/sf0.001")), "Inner")
