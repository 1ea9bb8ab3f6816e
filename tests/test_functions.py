"""Coordinate and code functions on small tables."""

from pyspark.sql import functions as F

from loam.functions import codes as C
from loam.functions import geometry as G


def column(spark, expression, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def test_chunks_floor_below_zero(spark):
    assert column(spark, G.to_chunk(F.col("v")), [(-1.0,), (-32.0,), (-32.5,), (31.9,), (32.0,)], "v double") == [-1, -1, -2, 0, 1]


def test_positions_round_trip_and_reject(spark):
    rows = [(0, 0, 0, 0), (-1, 511, -1048576, 1023), (1048575, 3, 7, 32), (1048576, 0, 0, 0), (0, 512, 0, 0), (0, 0, 0, 1024)]
    df = spark.createDataFrame(rows, "x int, y int, z int, dim int").withColumn("k", G.encode_position(F.col("x"), F.col("y"), F.col("z"), F.col("dim")))
    out = df.withColumn("p", G.decode_position(F.col("k"))).collect()
    assert [tuple(r.p) if r.p else None for r in out] == [*rows[:3], None, None, None]
    bad = [(1 << 21,), (1 << 48,), (-(1 << 63),)]
    assert column(spark, G.decode_position(F.col("k")), bad, "k long") == [None] * 3


def test_circle_includes_its_edge(spark):
    df = G.circle_cells(spark.createDataFrame([(0, 0, 5), (10, 10, 0)], "cx int, cz int, radius int"))
    cells = {(r.x, r.z) for r in df.where("radius = 5").collect()}
    assert cells == {(x, z) for x in range(-5, 6) for z in range(-5, 6) if x * x + z * z <= 25}
    assert df.where("radius = 0").count() == 1


def test_plan_clips_to_the_world(spark):
    asked = spark.createDataFrame([(-100, 10, 20), (95, 95, 1), (48, 48, 500)], "cx int, cz int, radius int")
    plan = G.plan_mapchunks(asked, 96, 96)
    assert {r["radius"]: r["count"] for r in plan.groupBy("radius").count().collect()} == {1: 1, 500: 9}


def test_square_ring_order(spark):
    ring = G.square_ring(spark.createDataFrame([(0, 0, 1)], "tx int, tz int, d int")).orderBy("place").collect()
    assert [(r.rx, r.rz) for r in ring] == [(-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0)]


def test_nearest_lod_ties_go_to_the_finer(spark):
    assert column(spark, G.nearest_lod(F.col("p")), [(1.0,), (0.5,), (2.0,), (0.01,), (2**-0.5,)], "p double") == [0, 1, 0, 5, 0]


CODES = [
    (0, "game:air"), (1, "game:rock-granite"), (4, "game:rock-sandstone"), (9, "game:forestfloor-3"), (16, "game:tallgrass-medium-free"), (17, "game:leaves-grown-oak"),
    (19, "game:snowblock"), (20, "game:sand-granite"), (24, "game:peat-none"), (29, "mod:machine-coil"), (40, None), (41, "unknown:41"), (42, "game:water-still-7"),
]


def test_surface_class(spark):
    df = spark.createDataFrame(CODES, "block_id int, code string")
    no = F.lit(None).cast("string")
    got = {r.block_id: r.c for r in df.select("block_id", C.surface_class(F.col("block_id"), F.col("code"), F.lit(0), no).alias("c")).collect()}
    assert got == {0: "UNKNOWN", 1: "ROCK", 4: "ROCK", 9: "FOREST_FLOOR", 16: "VEGETATION", 17: "VEGETATION", 19: "SNOW", 20: "SAND", 24: "SOIL", 29: "UNKNOWN", 40: "UNKNOWN", 41: "UNKNOWN", 42: "WATER"}
    wet = df.select(C.surface_class(F.col("block_id"), F.col("code"), F.lit(18), F.lit("game:water-still-7")).alias("c")).distinct().collect()
    assert [r.c for r in wet] == ["WATER"]


def test_ore_is_a_path_prefix(spark):
    rows = [("game:ore-rich-x",), ("ore-x",), ("game:forest",), ("a:b:ore-x",), (None,), ("game:looseores-x",)]
    assert column(spark, C.is_ore(F.col("c")), rows, "c string") == [True, True, False, False, False, False]
    assert column(spark, C.match_ore(F.col("c"), F.lit("  RICH ")), rows, "c string")[:2] == [True, False]
    assert column(spark, C.match_ore(F.col("c"), F.lit(" ")), rows[:1], "c string") == [False]


def test_soil_fertility(spark):
    rows = [("game:soil-medium-normal",), ("soil-compost-none",), ("mod:soil-low-none",), ("bonysoil",), ("bonysoil-8",), ("forestfloor-0",), ("farmland-moist-high",), ("farmland-wet-high",), ("soil-low",), (None,)]
    got = column(spark, C.soil_fertility(F.col("c")), rows, "c string")
    assert [(g.tier, g.percent) if g else None for g in got] == [("MEDIUM", 50), ("TERRA_PRETA", 80), None, ("BONY", 0), None, ("LOW", 25), ("HIGH", 65), None, None, None]


def test_rock_and_objects(spark):
    rows = [("game:rock-granite",), ("rock-",), ("a:b:rock-x",), ("game:rock granite",), (" Rock-Basalt ",)]
    assert column(spark, C.rock_code(F.col("c")), rows, "c string") == ["game:rock-granite", None, None, None, "rock-basalt"]
    rows = [("game:looseores-native-copper-granite-free",), ("looseflints-granite-free",), ("looseores-x-free",), ("loosestones--free",), ("looseflints-granite-lava",), (None,)]
    got = column(spark, C.object_identity(F.col("c")), rows, "c string")
    assert [(g.namespace, g.key, g.host_rock, g.variant) if g else None for g in got] == [("game", "native-copper", "granite", "free"), ("", "granite", None, "free"), None, None, None, None]
