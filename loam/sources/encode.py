"""Raw tables made from typed ones, the inverse of the decode jobs.

Round trips over derived worlds use them, and tests.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import payloads as P


#: Packed chunks that leave a task at once.
PACKED = 64


def raw_chunks(voxels: DataFrame) -> DataFrame:
    """cx, cy, cz, position, data of the chunks of voxels (x, y, z, block_id).

    A chunk's voxels reach Python one after the other and are packed as the last one
    comes, so a task holds one chunk and a batch of voxels, however full chunks are and
    however many of them it has.
    """
    keys = {f"c{c}": G.to_chunk(F.col(c)) for c in "xyz"}
    cells = voxels.withColumns(keys).withColumn("at", G.voxel_index(*(F.col(c) for c in "xyz"))).select(*keys, "at", "block_id")
    cells = cells.repartition(*keys).sortWithinPartitions(*keys)

    def pack(batches):
        out, key, blocks = [], None, None
        for batch in batches:
            cx, cy, cz, at, ids = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(at):
                continue
            change = np.flatnonzero((np.diff(cx) != 0) | (np.diff(cy) != 0) | (np.diff(cz) != 0)) + 1
            edges = [0, *change.tolist(), len(at)]
            for low, high in zip(edges, edges[1:]):
                now = int(cx[low]), int(cy[low]), int(cz[low])
                if now != key:
                    if key is not None:
                        out.append((*key, P.put_chunk(blocks)))
                    key, blocks = now, np.zeros(P.CELLS, np.int32)
                blocks[at[low:high]] = ids[low:high]
            if len(out) >= PACKED:
                yield rows(out)
                out = []
        if key is not None:
            yield rows([*out, (*key, P.put_chunk(blocks))])

    def rows(out):
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["cx", "cy", "cz", "data"])

    packed = cells.mapInArrow(pack, "cx int, cy int, cz int, data binary")
    return packed.select(*keys, G.encode_position(F.col("cx"), F.col("cy"), F.col("cz"), F.lit(0)).alias("position"), "data")


def raw_mapchunks(heights: DataFrame) -> DataFrame:
    """mx, mz, position, data of the mapchunks of heights (x, z, rain_y,
    terrain_y); columns without a height are 0."""
    keys = {"mx": G.to_chunk(F.col("x")), "mz": G.to_chunk(F.col("z"))}
    index = G.column_index(F.col("x"), F.col("z"))
    cells = heights.withColumns(keys).groupBy(*keys).agg(*[F.collect_list(c).alias(n) for c, n in ((index, "at"), (F.col("rain_y"), "rain"), (F.col("terrain_y"), "terrain"))])

    def pack(at: pd.Series, rain: pd.Series, terrain: pd.Series) -> pd.Series:
        out = []
        for a, r, t in zip(at, rain, terrain):
            maps = np.zeros((2, 1024), np.int64)
            maps[:, np.asarray(a, np.int64)] = [r, t]
            out.append(P.put_numbers(3, maps[0]) + P.put_numbers(7, maps[1]))
        return pd.Series(out)

    packed = F.pandas_udf(pack, "binary")
    return cells.select(*keys, G.encode_position(F.col("mx"), F.lit(0), F.col("mz"), F.lit(0)).alias("position"), packed("at", "rain", "terrain").alias("data"))


def raw_regions(cells: DataFrame, size: int = 18) -> DataFrame:
    """rx, rz, position, data of the regions of layer cells (rx, rz, layer, lx,
    lz, raw); cells without a value are 0."""
    named = cells.withColumn("at", F.col("lz") * size + F.col("lx"))
    grouped = named.groupBy("rx", "rz").agg(F.collect_list(F.struct("layer", "at", "raw")).alias("cells"))
    numbers = {"landform": 1, "forest": 2, "climate": 3, "province": 4, "ocean": 18}

    def pack(rows: pd.Series) -> pd.Series:
        out = []
        for row in rows:
            layers: dict[str, np.ndarray] = {}
            for c in row:
                layers.setdefault(c["layer"], np.zeros(size * size, np.int64))[c["at"]] = c["raw"]
            raw = b""
            for name, values in sorted(layers.items()):
                data = P.put_map(values, size)
                raw += P.put(numbers[name], data) if name in numbers else P.put(8, P.put(1, name.removeprefix("ore:")) + P.put(2, data))
            out.append(raw)
        return pd.Series(out)

    packed = F.pandas_udf(pack, "binary")
    return grouped.select("rx", "rz", G.encode_position(F.col("rx"), F.lit(0), F.col("rz"), F.lit(0)).alias("position"), packed("cells").alias("data"))


def raw_registry(registry: DataFrame, size: tuple[int, int, int] = (96, 128, 96)) -> DataFrame:
    """One row: the save game's payload with the registry and the world size."""
    pairs = registry.agg(F.array_sort(F.collect_list(F.struct("block_id", "code"))).alias("pairs"))

    def pack(rows: pd.Series) -> pd.Series:
        out = []
        for row in rows:
            body = b"".join(P.put(1, P.put(1, int(p["block_id"])) + P.put(2, p["code"])) for p in row)
            out.append(b"".join(P.put(i, n) for i, n in enumerate(size, 1)) + P.put(11, P.put(1, "BlockIDs") + P.put(2, body)))
        return pd.Series(out)

    return pairs.select(F.pandas_udf(pack, "binary")("pairs").alias("data"))
