"""Chunks are packed as their voxels come: a task never holds the chunks of a batch."""

import random

import numpy as np
from pyspark.sql import functions as F

from loam.operators import components
from loam.sources import decode, encode


def test_chunks_are_packed_as_a_stream(spark):
    rnd = random.Random(5)
    cells = {(rnd.randrange(-64, 2400), rnd.randrange(64), rnd.randrange(32)): rnd.randrange(9) for _ in range(12_000)}
    voxels = spark.createDataFrame([(*k, v) for k, v in cells.items()], "x int, y int, z int, block_id int")
    raw = encode.raw_chunks(voxels)
    plan = raw._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ArrowEvalPython" not in plan
    want = {}
    for (x, y, z), v in cells.items():
        want.setdefault((x // 32, y // 32, z // 32), np.zeros(32768, np.int32))[(y % 32 * 32 + z % 32) * 32 + x % 32] = v
    found = {(r.cx, r.cy, r.cz): r.blocks for r in decode.decode_chunk(raw.select("cx", "cy", "cz", "data")).collect()}
    assert len(found) == raw.count() and found.keys() == want.keys()
    assert all(np.array_equal(np.asarray(found[k]), v) for k, v in want.items())
    assert encode.raw_chunks(voxels.where("false")).count() == 0


def test_labels_of_cells_are_not_broadcast(spark, tmp_path):
    spark.range(4096).selectExpr("CAST(id % 64 AS INT) x", "CAST(id DIV 64 AS INT) z").write.parquet(str(tmp_path / "cells"))
    near = components.neighbours8(spark.read.parquet(str(tmp_path / "cells")))
    assert "BroadcastHashJoin" not in near._jdf.queryExecution().executedPlan().toString()
    assert near.agg(F.count(F.lit(1))).first()[0] == 2 * 64 * 63 + 2 * 63 * 63
