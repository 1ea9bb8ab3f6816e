"""Chunk tables in buckets: the same results, and no shuffle of columns."""

import random
import re

from loam.operators import rock, surface
from loam.sources import bucketed


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_rock_and_surface_over_buckets_need_no_exchange_of_columns(spark, tmp_path):
    rnd = random.Random(9)
    codes = ["game:air", "game:rock-granite", "game:soil-medium-normal", "game:leaves-grown-oak", "game:water-still-7", "game:rock-basalt"]
    registry = spark.createDataFrame(list(enumerate(codes)), "block_id int, code string")
    cells = {(rnd.randrange(200), rnd.randrange(64), rnd.randrange(90)): rnd.randrange(6) for _ in range(9000)}
    voxels = spark.createDataFrame([(*k, v) for k, v in cells.items()], "x int, y int, z int, block_id int")
    top = {}
    for x, y, z in cells:
        top[x, z] = max(top.get((x, z), 0), y)
    heights = spark.createDataFrame([(x, z, y) for (x, z), y in top.items() if (x // 32 + z // 32) % 4], "x int, z int, rain_y int")
    liquids = spark.createDataFrame([(*k, 4) for k in cells if k[0] % 3 == 0], "x int, y int, z int, liquid_id int")
    coverage = spark.createDataFrame([(cx, cy, cz, rnd.choice(["AVAILABLE"] * 5 + ["FAILED"])) for cx in range(7) for cy in range(2) for cz in range(3)], "cx int, cy int, cz int, status string")
    dry = spark.createDataFrame([(1, 1)], "mx int, mz int")
    plain = rows(rock.upper_rock(voxels, registry, coverage, voxels, 0, 63)), rows(surface.resolve_surface(voxels, heights, voxels, registry, liquids, coverage, dry, 64))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bucketed.co_located(spark)
        v, h, q, c = (bucketed.write(df, str(tmp_path / n), 4) for n, df in (("v", voxels), ("h", heights), ("q", liquids), ("c", coverage)))
        columns = v.select("cx", "cz", "x", "z")
        found = rock.upper_rock(v, registry, c, columns, 0, 63)
        assert rows(found) == plain[0]
        assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
        # the plan up to the flags, which are stored, and the one after them
        plans = []
        real, surface.store = surface.store, lambda df, name: (plans.append(df), real(df, name))[1]
        try:
            resolved = surface.resolve_surface(columns, h, v, registry, q, c, dry, 64)
        finally:
            surface.store = real
        assert rows(resolved) == plain[1]
        for df in (*plans, resolved):
            text = df._jdf.queryExecution().executedPlan().toString()
            assert not re.search(r"Exchange hashpartitioning\([^)]*\b[xz]#", text), text
    finally:
        for k, value in kept.items():
            spark.conf.set(k, value)
