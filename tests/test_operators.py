"""Operator semantics, decode failures, stored tables and streams."""

import itertools
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.functions import geometry as G
from loam.operators import components as K
from loam.operators import ore, prospecting, regions, rock, surface
from loam.operators.graph import components, numbered
from loam.operators.tables import layer_completeness, require_unique, stored_columns
from loam.sources import decode, savefile
from loam.sources import payloads as P
from loam.sources import tables as T
from loam.streaming import refresh


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_components_match_a_union_find(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (None, 3)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.node: r.component for r in got.collect()} == {n: find(n) for n in list(parent)}
    assert got.count() == got.select("node").distinct().count()
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


REGISTRY = [(1, "game:rock-granite"), (2, "game:rock-basalt"), (5, "game:ore-rich-copper-granite"), (6, "game:water-still-7")]


def rock_of(spark, voxels, gaps):
    v = spark.createDataFrame(voxels, "x int, y int, z int, block_id int")
    cov = spark.createDataFrame([(0, cy, 0, gaps.get(cy, "AVAILABLE")) for cy in range(4)], "cx int, cy int, cz int, status string")
    cells = spark.createDataFrame([(0, 0), (1, 0)], "x int, z int")
    return {(r.x, r.z): (r.state, r.y) for r in rock.upper_rock(v, spark.createDataFrame(REGISTRY, "block_id int, code string"), cov, cells, 0, 127).collect()}


def test_rock_states(spark):
    voxels = [(0, 40, 0, 1), (0, 10, 0, 2)]
    assert rock_of(spark, voxels, {}) == {(0, 0): ("OBSERVED", 40), (1, 0): ("NO_ROCK", None)}
    assert rock_of(spark, voxels, {0: "MISSING"}) == {(0, 0): ("OBSERVED", 40), (1, 0): ("UNAVAILABLE", None)}
    assert rock_of(spark, voxels, {3: "FAILED"})[(0, 0)] == ("UNAVAILABLE", None)
    assert rock_of(spark, voxels, {1: "FAILED"})[(0, 0)] == ("UNAVAILABLE", None)
    assert rock_of(spark, [(0, 63, 0, 1)], {})[(0, 0)] == ("OBSERVED", 63)


def test_arrival_order_does_not_matter(spark):
    voxels = [(x, y, 0, 1 + (x + y) % 2) for x in range(2) for y in range(0, 90, 7)]
    shuffled = voxels[:]
    random.Random(1).shuffle(shuffled)
    assert rock_of(spark, voxels, {}) == rock_of(spark, shuffled, {})


def test_ore_totals_keep_resources_without_hits(spark):
    requests = spark.createDataFrame([(1, "copper", "ORE_CODE", 0, 0, 5, 0, 127), (1, "tin", "ORE_CODE", 0, 0, 5, 0, 127)], "request_id int, resource string, mode string, cx int, cz int, radius int, y_min int, y_max int")
    voxels = spark.createDataFrame([(0, 3, 0, 5), (0, 9, 0, 5), (5, 1, 0, 5), (5, 1, 1, 5), (0, 1, 0, 1)], "x int, y int, z int, block_id int")
    registry = spark.createDataFrame(REGISTRY, "block_id int, code string")
    columns = ore.ore_columns(voxels, registry, requests)
    assert rows(columns) == [(1, "copper", 0, 0, 2, 3, 9), (1, "copper", 5, 0, 1, 1, 1)]
    assert rows(ore.ore_totals(columns, requests)) == [(1, "copper", 3, 2, 1, 9), (1, "tin", 0, 0, -1, -1)]
    assert rows(ore.ore_map(ore.chunk_table(voxels), registry, requests, (96, 128, 96))) == rows(columns)
    back = ore.voxels_of_masks(ore.y_masks(voxels))
    assert rows(back.select("x", "y", "z", "block_id")) == rows(voxels)


def test_masks_take_one_shuffle_over_tasks_that_grow(spark):
    """Voxels and masks are grouped where one shuffle puts them, half a million rows of lineitem to a task."""
    import re

    from loam.plans.worldviews import World

    for scale, tasks in ((12, spark.sparkContext.defaultParallelism), (4000, 400)):
        w = World(spark, "/root/testdata/sf0.001")
        w.scale = scale
        plan = ore.y_masks(w.voxels_by_column())._jdf.queryExecution().executedPlan().toString()
        assert re.findall(r"Exchange hashpartitioning\((x#\d+), (z#\d+), (\d+)\)", plan)[0][2] == str(tasks) and plan.count("Exchange ") == 1


def test_indexed_map_deals_voxels_over_tasks_that_grow(spark):
    from loam.plans.worldviews import World

    w = World(spark, "/root/testdata/sf0.001")
    w.scale = 4000
    plan = ore.ore_map_indexed(ore.y_masks(w.voxels_by_column()), w.indexed_cov, w.registry, w.requests, w.size)._jdf.queryExecution().executedPlan().toString()
    assert ", 400), REPARTITION_BY_NUM" in plan


def test_deposits_touch_at_corners(spark):
    cells = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (5, 5), (5, 7)], "x int, z int")
    got = {(r.x, r.z): r.component for r in K.components8(cells).collect()}
    assert got[(0, 0)] == got[(1, 1)] == got[(2, 0)] == 0
    assert len({got[(5, 5)], got[(5, 7)], 0}) == 3


def test_deposits_across_mapchunks(spark):
    rnd = random.Random(9)
    cells = sorted({(rnd.randrange(-70, 70), rnd.randrange(-70, 70)) for _ in range(6000)})
    name, left = {}, set(cells)
    for first in cells:
        if first in left:
            queue = [first]
            left.discard(first)
            while queue:
                x, z = queue.pop()
                name[x, z] = (first[0] << 32) + first[1]
                near = {(x + i, z + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
                left -= near
                queue += near
    assert len(set(name.values())) > 50
    got = K.components8(spark.createDataFrame(cells, "x int, z int"))
    assert {(r.x, r.z): r.component for r in got.collect()} == name
    assert K.components8(spark.createDataFrame([], "x int, z int")).count() == 0


def test_key_runs(spark):
    keys = [*range(65530, 65545), *range(200000, 200003), 5, 5, None]
    got = rows(regions.key_runs(spark.createDataFrame([(k,) for k in keys], "k long"), "k"))
    assert got == [(200000, 200002, 3), (5, 5, 1), (65530, 65544, 15)]


def test_key_runs_over_far_ranges(spark):
    rnd = random.Random(5)
    keys = {rnd.randrange(-(1 << 50), 1 << 50) for _ in range(50)} | {-1, 0, (1 << 32) - 1, 1 << 32, (1 << 48) - 1, 1 << 48, (1 << 62) - 1, 1 << 62}
    keys |= set(range((5 << 16) - 3, (8 << 16) + 2)) | set(range(-(1 << 16) - 2, -(1 << 16) + 2))  # over whole parts, and below zero
    want, run = [], []
    for k in sorted(keys):
        if run and k != run[-1] + 1:
            want.append((run[0], run[-1], len(run)))
            run = []
        run.append(k)
    want.append((run[0], run[-1], len(run)))
    got = regions.key_runs(spark.createDataFrame([(k,) for k in keys], "k long"), "k")
    assert sorted(map(tuple, got.collect())) == want


def test_places_over_all_rows(spark):
    rnd = random.Random(2)
    values = [rnd.randrange(1000) for _ in range(500)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(7)
    got = {r.i: r.place for r in numbered(df, F.desc("v"), F.col("i")).collect()}
    assert got == {i: n for n, (_, i) in enumerate(sorted((-v, i) for i, v in enumerate(values)), 1)}
    assert numbered(df.limit(0), F.desc("v"), F.col("i")).count() == 0


def test_scopes_drop_their_tables(spark):
    from loam.operators.graph import scope, scratch, store

    with scope(spark):
        gone, path = store(spark.range(3), "gone")
        with scope(spark):
            inner, inner_path = store(gone, "inner", kept=True)
        assert inner.count() == 3 and inner_path.startswith(path.rsplit("/", 1)[0])
        kept, _ = store(inner, "kept", kept=True)
    assert kept.count() == 3 and not T.exists(spark, path) and not T.exists(spark, inner_path) and "scope" not in scratch(spark, "x")


def test_small_tells_sizes(spark):
    from loam.operators import dims

    wide = spark.range(300).selectExpr("id", "explode(sequence(1, 50)) AS n")
    assert dims.is_small(spark.createDataFrame([(1,)], "a int")) and dims.is_small(wide) and not dims.is_small(wide, most=1000)


def test_surface_takes_the_highest_that_counts(spark):
    registry = spark.createDataFrame([(0, "game:air"), (1, "game:rock-granite"), (6, "game:water-still-7"), (7, "game:tallgrass-free"), (9, "game:sand")], "block_id int, code string")
    voxels = [(0, 5, 0, 1), (0, 6, 0, 7), (0, 7, 0, 0), (1, 5, 0, 1), (1, 6, 0, 7), (2, 4, 0, 0), (3, 1, 0, 9), (3, 9, 0, 77), (4, 3, 0, 1), (4, 8, 0, 0)]
    liquids = [(1, 6, 0, 6), (2, 4, 0, 6), (4, 3, 0, 6), (4, 9, 0, 6)]
    got = surface.surface_top(spark.createDataFrame(voxels, "x int, y int, z int, block_id int"), registry, spark.createDataFrame(liquids, "x int, y int, z int, liquid_id int"))
    assert rows(got.select("x", "y", "block_id", "liquid_id", "class")) == [(0, 5, 1, 0, "ROCK"), (1, 6, 7, 6, "WATER"), (2, 4, 0, 6, "WATER"), (3, 9, 77, 0, "UNKNOWN"), (4, 3, 1, 6, "WATER")]


def test_many_wanted_ids_are_joined(spark, monkeypatch):
    voxels = spark.createDataFrame([(x, 0, 0, x // 32) for x in range(0, 320, 8)], "x int, y int, z int, block_id int")
    chunks, wanted = ore.chunk_table(voxels), spark.createDataFrame([(3,), (5,), (5,), (400,)], "block_id int")
    at = chunks.select("cx", "cy", "cz")
    few = rows(ore.selective_chunks(chunks, at, wanted).select("cx"))
    monkeypatch.setattr(ore, "is_small", lambda df: False)
    assert few == rows(ore.selective_chunks(chunks, at, wanted).select("cx")) == [(3,), (5,)]


def test_inner_cells_of_any_size(spark):
    cells = spark.createDataFrame([(0, 0, lx, lz, 7, 1, 2) for lx in range(7) for lz in range(7)], "rx int, rz int, lx int, lz int, size int, pad_low int, pad_high int")
    got = G.inner_cells(cells, F.col("size"), F.col("pad_low"), F.col("pad_high")).orderBy("lx", "lz").collect()
    assert len(got) == 16 and (got[0].lx, got[0].x0, got[0].x1) == (1, 0.0, 128.0) and got[-1].x1 == 512.0
    odd = G.inner_cells(spark.createDataFrame([(1, 0, 2, 1)], "rx int, rz int, lx int, lz int"), 5, 1, 1).first()
    assert odd.x0 == 512 + 512 / 3 and odd.z1 == 512 / 3


def test_stored_columns_serve_whole_circles_only(spark):
    stored = spark.createDataFrame([(x, z, 64, 64, "s") for x in range(40) for z in range(64)], "x int, z int, size_x int, size_z int, state string")
    stored = T.with_region(stored)
    circles = spark.createDataFrame([(1, 10, 10, 5), (2, 2, 10, 5), (3, 38, 30, 5), (4, 20, 20, 0)], "circle int, cx int, cz int, radius int")
    count = lambda df: {(r.circle, r.served): r.n for r in df.groupBy("circle", "served").agg(F.count("x").alias("n")).collect()}
    got = stored_columns(stored, circles, 64, 64)
    assert count(got) == {(1, True): 81, (2, False): 0, (3, False): 0, (4, True): 1}
    assert {s for _, s in count(stored_columns(stored, circles, 96, 64))} == {False}  # stored for a world of another size
    assert {s for _, s in count(stored_columns(stored.limit(0), circles, 64, 64))} == {False}


def test_preparation_keeps_what_a_cancelled_run_leaves(spark, tmp_path):
    path, built = str(tmp_path / "prepared"), []
    wanted = {n: spark.range(5).select(F.col("id").alias("k")) for n in "abc"}
    build = {n: (lambda n: lambda todo: built.append((n, todo.count())) or todo)(n) for n in "abc"}
    keys = {n: ["k"] for n in "abc"}
    assert T.prepare(wanted, build, path, keys) == {"a": 5, "b": 5, "c": 5}
    wanted = {n: spark.range(8).select(F.col("id").alias("k")) for n in "abc"}
    assert T.prepare(wanted, build, path, keys, stop=lambda layer: layer == "b") == {"a": 3}
    assert {n: spark.read.parquet(f"{path}/{n}").count() for n in "abc"} == {"a": 8, "b": 5, "c": 5}
    assert T.prepare(wanted, build, path, keys) == {"a": 0, "b": 3, "c": 3} and built[3:] == [("a", 3), ("b", 3), ("c", 3)]
    assert rows(T.prepared(spark, path, "abcd")) == [("a", True), ("b", True), ("c", True), ("d", False)]


def test_reading_is_told_in_full(spark):
    read = [(i, "READ", None, "bad\n" if i < 14 else None) for i in range(20)] + [(30, "IGNORED", None, None), (31, "INVALID", " ", None), (32, "READ", "no layer", None)]
    got = [tuple(r) for r in decode.read_diagnostics(spark.createDataFrame(read, "id long, status string, error string, liquid_error string")).collect()]
    assert sorted(got, key=repr) == sorted([("PARSED", None, 20), ("SKIPPED", "unspecified", 1), ("FAILED", "unspecified", 1), ("FAILED", "no layer", 1), ("LIQUID", None, 14)] + [("LIQUID_SAMPLE", "liquid decode failed: bad", 1)] * 10, key=repr)


def test_header_without_a_player(spark):
    meta = spark.createDataFrame([(96, 128, 64, None)], "size_x int, size_y int, size_z int, error string")
    registry = spark.createDataFrame(REGISTRY, "block_id int, code string")
    players = spark.createDataFrame([("b", 1, 2), ("a", 3, 4)], "record string, x int, z int")
    assert rows(decode.world_header(meta, registry, players)) == [(96, 128, 64, 4, "a", 3, 4)]
    assert rows(decode.world_header(meta, registry, players.limit(0))) == [(96, 128, 64, 4, None, None, None)]
    assert decode.default_player(players.limit(0)).count() == 0


def test_empty_coverage_is_zero(spark):
    got = regions.coverage_summary(spark.createDataFrame([], "rx int, rz int")).first()
    assert got.present == 0 and got.possible == 0 and got.percent == 0.0


def test_assessment_rules_in_order(spark):
    grid = list(itertools.product(("OBSERVED", "UNAVAILABLE", "NOT_OBSERVED"), ("OBSERVED", "UNAVAILABLE", "NO_ROCK"), (None, 0.0, 0.5), ("COMPATIBLE", "INCOMPATIBLE", "UNKNOWN")))

    def rank(observation, geology, signal, fit):
        positive = signal is not None and signal > 0
        if observation == "OBSERVED":
            return "CONFIRMED"
        if geology == "UNAVAILABLE":
            return "UNKNOWN"
        if positive and fit != "UNKNOWN":
            return "STRONG" if fit == "COMPATIBLE" else "WEAK"
        return "INTERESTING" if positive or fit == "COMPATIBLE" else "UNKNOWN"

    df = spark.createDataFrame([(1, f"r{i:02d}", *g, 5, 0, i % 2) for i, g in enumerate(grid)], "request_id int, resource string, observation string, geology string, signal double, compatibility string, observed int, no_rock int, unavailable int")
    out = prospecting.assess(df).collect()
    assert all(5 <= len(r.reasons) <= 7 and ("observed geology coverage is partial" in r.reasons) == (r.unavailable > 0) for r in out)
    assert all(("worldgen signal=0.5" in r.reasons) == (r.signal == 0.5) and f"host compatibility={r.compatibility}" in r.reasons for r in out)
    assert out[0].reasons[3] == "geology coverage: observed=5, no-rock=0, unavailable=0" or out[0].unavailable
    assert all(r["rank"] == rank(r.observation, r.geology, r.signal, r.compatibility) for r in out)
    ordered = [r["rank"] for r in sorted(out, key=lambda r: r.place)]
    assert ordered == sorted(ordered, key=prospecting.RANKS.index)


def test_layers_round_trip():
    rnd = np.random.default_rng(0)
    for values in (np.zeros(32768), np.full(32768, 7), rnd.integers(0, 2, 32768), rnd.integers(0, 19, 32768), rnd.integers(-5, 4000, 32768)):
        for zipped in (False, True):
            assert (P.layer_values(P.put_layer(values, zipped)) == values).all()


def test_broken_chunks_keep_their_rows(spark):
    blocks = np.arange(32768) % 5
    good = P.put_chunk(blocks, blocks)
    cases = [("good", good), ("empty", b""), ("null", None), ("cut", good[:40]), ("version", P.put_chunk(blocks, version=3)), ("nothing", P.put(15, 2)), ("liquid", P.put_chunk(blocks) + P.put(16, b"\1\0\0\0x"))]
    raw = spark.createDataFrame([(n, bytearray(d) if d is not None else None) for n, d in cases], "name string, data binary")
    got = {r.name: r for r in decode.decode_chunk(raw).collect()}
    assert len(got) == len(cases)
    assert got["good"].error is None and got["good"].blocks == blocks.tolist() and got["good"].liquids == blocks.tolist()
    assert all(got[n].error and got[n].blocks is None for n in ("empty", "null", "cut", "version", "nothing"))
    assert got["liquid"].error is None and got["liquid"].liquids is None and got["liquid"].liquid_error


def test_heights_must_be_whole(spark):
    cases = [("both", P.put_numbers(3, range(1024)) + P.put_numbers(7, range(1024))), ("rain", P.put_numbers(3, [5] * 1024)), ("short", P.put_numbers(3, [5] * 1023)), ("none", P.put(1, 4))]
    got = {r.name: r for r in decode.decode_heights(spark.createDataFrame([(n, bytearray(d)) for n, d in cases], "name string, data binary")).collect()}
    assert got["both"].rain == list(range(1024)) and got["rain"].terrain is None and got["rain"].error is None
    assert got["short"].error and got["none"].error


def test_save_file_source(spark, tmp_path):
    path = str(tmp_path / "world.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE chunk (position INTEGER PRIMARY KEY, data BLOB)")
        db.executemany("INSERT INTO chunk VALUES (?, ?)", [(i * 3, bytes([i])) for i in range(50)])
        db.execute("CREATE TABLE mapchunk (position INTEGER PRIMARY KEY, data BLOB)")
    spark.dataSource.register(savefile.SaveFile)
    got = spark.read.format("loam_save").option("table", "chunk").load(path)
    assert rows(got.select("position")) == sorted(((i * 3,) for i in range(50)), key=repr)
    assert spark.read.format("loam_save").option("table", "mapchunk").load(path).count() == 0


def test_duplicates_and_clipped_tiles_are_refused(spark, tmp_path):
    cov = spark.createDataFrame([(0, 0, 0, "AVAILABLE"), (0, 0, 0, "FAILED")], "cx int, cy int, cz int, status string")
    with pytest.raises(ValueError):
        require_unique(cov, ["cx", "cy", "cz"])
    with pytest.raises(ValueError):
        T.write_surface(spark.createDataFrame([(0, 0, "ROCK")], "x int, z int, class string"), str(tmp_path / "s"))


def test_completeness_states(spark):
    none, some = spark.range(0), spark.range(3)
    state = lambda **k: {r.revision for r in layer_completeness(k).collect()}
    assert state(a=none, b=none) == {"READY"} and state(a=none, b=some) == {"PARTIAL"} and state(a=some, b=some) == {"NOT_PREPARED"}


def test_upsert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "index")
    batch = spark.createDataFrame([(1, 0, 0, 0, "FAILED"), (5, 0, 0, 0, "AVAILABLE"), (2, 20, 0, 0, "FAILED")], "event_id long, cx int, cy int, cz int, status string")
    refresh.upsert(batch, path)
    refresh.upsert(batch, path)
    refresh.upsert(spark.createDataFrame([(3, 0, 0, 0, "FAILED"), (9, 1, 1, 1, "FAILED")], batch.schema), path)
    got = rows(spark.read.parquet(path).select("cx", "event_id", "status"))
    assert got == [(0, 5, "AVAILABLE"), (1, 9, "FAILED"), (20, 2, "FAILED")]


def test_small_graphs_end_as_large_ones(spark):
    import random

    from loam.operators.components import small_components
    from loam.operators.graph import components

    rnd = random.Random(6)
    edges = [(rnd.randrange(300) << 33, rnd.randrange(300) << 33) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(4)
    assert rows(small_components(df)) == rows(components(df)) and small_components(df.limit(0)).count() == 0
