"""Decode jobs: raw tables of packed keys and payloads to typed columns.

Each job keeps every row and never fails on one: what can't be read gets a null
value and an error text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import payloads as P

MAP = "struct<size:int,pad_low:int,pad_high:int,data:array<int>>"

#: Voxels that leave a task at once, unless a single chunk has more.
UNFOLDED = 32768


def _rows(raw: DataFrame, one, schema: str, whole: bool = False) -> DataFrame:
    """raw (.., data) with data replaced by the columns that one(bytes) gives and
    a column error, or, if whole, with those beside data. Batches are small, as
    payloads unfold."""
    from pyspark.sql.types import _parse_datatype_string

    added = _parse_datatype_string(schema + ", error string")
    rest = [c for c in raw.columns if c != "data"]
    keep = [*rest, "data"] if whole else rest
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType([raw.schema[c] for c in keep] + added.fields)
    arrow = to_arrow_schema(out)
    n = len(added.fields) - 1

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = []
                for data in part.column("data"):
                    try:
                        payload = data.as_py()
                        if not payload:
                            raise ValueError("payload is empty")
                        found.append((*one(payload), None))
                    except (ValueError, IndexError, UnicodeDecodeError) as e:
                        found.append((*[None] * n, str(e)))
                columns = [pa.array(c, arrow.field(f.name).type) for c, f in zip(zip(*found), added.fields)]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], *columns], schema=arrow)

    return raw.select(*rest, "data").mapInArrow(run, out)


def scan_raw(raw: DataFrame, vertical: bool) -> DataFrame:
    """raw (position, data) with x, y, z, dim and a status: INVALID for a bad key
    or an empty payload, IGNORED outside the main dimension or, unless vertical,
    above the ground level, else READ."""
    at = raw.withColumn("p", G.decode_position(F.col("position"))).select("*", "p.x", "p.y", "p.z", "p.dim").drop("p")
    empty = F.col("data").isNull() | (F.length("data") == 0)
    other = (F.col("dim") != 0) if vertical else (F.col("dim") != 0) | (F.col("y") != 0)
    return at.withColumn("status", F.when(F.col("x").isNull(), "INVALID").when(other, "IGNORED").when(empty, "INVALID").otherwise("READ"))


def decode_heights(raw: DataFrame) -> DataFrame:
    """rain and terrain, 1024 values each or null; an error if both are absent."""

    def one(data):
        f = P.fields(data)
        out = []
        for name, number in (("rain heights", 3), ("terrain heights", 7)):
            v = P.numbers(f.get(number, []))
            if len(v) not in (0, 1024):
                raise ValueError(f"{name} must be 1024 values, got {len(v)}")
            out.append(v.tolist() if len(v) else None)
        if out == [None, None]:
            raise ValueError("no heights")
        return out

    return _rows(raw, one, "rain array<int>, terrain array<int>")


def _map(data: bytes) -> dict:
    f = P.fields(data)
    values, size = P.numbers(f.get(1, [])), (f.get(2) or [0])[-1]
    if len(values) != size * size:
        raise ValueError(f"map of size {size} has {len(values)} values")
    low, high = (f.get(3) or [0])[-1], (f.get(4) or [0])[-1]
    if low + high > size:
        raise ValueError("padding exceeds the map")
    return {"size": size, "pad_low": low, "pad_high": high, "data": values.tolist()}


def decode_map(raw: DataFrame) -> DataFrame:
    return _rows(raw, lambda data: (_map(data),), f"map {MAP}")


def decode_region(raw: DataFrame) -> DataFrame:
    """Layers landform, forest, climate, province, ocean, ore maps and strata."""

    def one(data):
        f = P.fields(data)
        single = [_map(f[n][-1]) if n in f else None for n in (1, 2, 3, 4, 18)]
        ores = {}
        for entry in f.get(8, []):
            e = P.fields(entry)
            if 1 in e and 2 in e:
                ores[e[1][-1].decode()] = _map(e[2][-1])
        return (*single, list(ores.items()), [_map(m) for m in f.get(12, [])])

    layers = ", ".join(f"{n} {MAP}" for n in ("landform", "forest", "climate", "province", "ocean"))
    return _rows(raw, one, f"{layers}, ores map<string,{MAP}>, strata array<{MAP}>")


def map_cells(regions: DataFrame) -> DataFrame:
    """Decoded regions (rx, rz, ..) as cells (rx, rz, layer, lx, lz, raw), the
    form of the region operators, with each map's own size, pad_low and pad_high for
    inner_cells(); layers of an error are absent."""
    named = [F.struct(F.lit(n).alias("layer"), F.col(n).alias("m")) for n in ("landform", "forest", "climate", "province", "ocean")]
    ores = F.transform(F.map_entries("ores"), lambda e: F.struct(F.concat(F.lit("ore:"), e["key"]).alias("layer"), e["value"].alias("m")))
    layers = regions.where("error IS NULL").select("rx", "rz", F.explode(F.concat(F.array(*named), ores)).alias("l")).where("l.m IS NOT NULL")
    cells = layers.select("rx", "rz", "l.layer", "l.m.size", "l.m.pad_low", "l.m.pad_high", F.posexplode("l.m.data").alias("i", "raw"))
    return cells.select("rx", "rz", "layer", F.expr("i % size").cast("int").alias("lx"), F.expr("i div size").cast("int").alias("lz"), "raw", "size", "pad_low", "pad_high")


def decode_chunk(raw: DataFrame) -> DataFrame:
    """palette, blocks, liquids and liquid_error. Absent liquids are all zero;
    liquids that can't be read are null with their error, the chunk stays."""

    def one(data):
        f = P.fields(data)
        palette, blocks = _palette(f), P.layer_values(f[1][-1])
        liquids, trouble = [0] * P.CELLS, None
        if 16 in f:
            try:
                liquids = P.layer_values(f[16][-1]).tolist()
            except ValueError as e:
                liquids, trouble = None, str(e)
        return palette, blocks.tolist(), liquids, trouble

    return _rows(raw, one, "palette array<int>, blocks array<int>, liquids array<int>, liquid_error string")


def decode_palette(raw: DataFrame) -> DataFrame:
    """The palette alone, without unfolding the layer."""

    return _rows(raw, lambda data: (_palette(P.fields(data)),), "palette array<int>")


def read_chunk(raw: DataFrame) -> DataFrame:
    """palette, with data: the palette of each chunk whose blocks decode_chunk() can
    unfold, and its error else. Blocks themselves don't leave the task, so rows that
    are stored stay as small as their payloads: read back, thousands of unfolded
    chunks at once take more than a task has."""

    def one(data):
        f = P.fields(data)
        palette = _palette(f)
        P.layer_values(f[1][-1])
        return (palette,)

    return _rows(raw, one, "palette array<int>", whole=True)


def _palette(f: dict[int, list]) -> list[int]:
    """The block ids of a chunk's fields, of a version that is known."""
    version = (f.get(15) or [None])[-1]
    if version != P.VERSION:
        raise ValueError(f"unsupported version {version}")
    if 1 not in f:
        raise ValueError("no block layer")
    return sorted(set(P.layer_palette(f[1][-1])[0].tolist())) or [0]


def raw_voxels(raw: DataFrame) -> DataFrame:
    """Chunks (cx, cy, cz, data) that read_chunk() read without an error, as voxels
    x, y, z of block ids other than 0. They leave the task chunk by chunk."""

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int32()) for c in zip(*out)], names=["x", "y", "z", "block_id"])

    def run(batches):
        out, n = [], 0
        for batch in batches:
            cx, cy, cz = (batch.column(i).to_pylist() for i in range(3))
            for i, data in enumerate(batch.column(3)):
                blocks = P.layer_values(P.fields(data.as_py())[1][-1])
                at = np.flatnonzero(blocks)
                if n and n + len(at) > UNFOLDED:
                    yield rows(out)
                    out, n = [], 0
                out.append((at % 32 + cx[i] * 32, at // 1024 + cy[i] * 32, at // 32 % 32 + cz[i] * 32, blocks[at]))
                n += len(at)
        if n:
            yield rows(out)

    return raw.select("cx", "cy", "cz", "data").mapInArrow(run, "x int, y int, z int, block_id int")


def chunk_voxels(chunks: DataFrame, column: str = "blocks", name: str = "block_id") -> DataFrame:
    """Decoded chunks (cx, cy, cz, ..) as voxels x, y, z of values other than 0."""
    cells = chunks.select("cx", "cy", "cz", F.posexplode(column).alias("i", name)).where(F.col(name) != 0)
    part = lambda c, div: (F.col(c) * 32 + F.expr(f"(i div {div}) % 32")).cast("int")
    return cells.select(part("cx", 1).alias("x"), part("cy", 1024).alias("y"), part("cz", 32).alias("z"), name)


def decode_registry(raw: DataFrame) -> DataFrame:
    """block_id and code of each registry entry; of a repeated id the last."""

    def one(data):
        out = {}
        for entry in P.fields(data).get(11, []):
            e = P.fields(entry)
            if [k.decode() for k in e.get(1, [])][-1:] != ["BlockIDs"] or 2 not in e:
                continue
            for pair in P.fields(e[2][-1]).get(1, []):
                p = P.fields(pair)
                if 1 in p and 2 in p:
                    out[p[1][-1] & 0x7FFFFFFF] = p[2][-1].decode()
        return (list(out.items()),)

    rows = _rows(raw, one, "codes map<int,string>")
    return rows.select(*[c for c in raw.columns if c != "data"], F.explode("codes").alias("block_id", "code"))


def decode_world_meta(raw: DataFrame) -> DataFrame:
    """size_x, size_y, size_z, all present and positive."""

    def one(data):
        f = P.fields(data)
        sizes = [(f.get(n) or [0])[-1] for n in (1, 2, 3)]
        if any(not isinstance(s, int) or not 0 < s < 1 << 31 for s in sizes):
            raise ValueError("world size is missing or not positive")
        return sizes

    return _rows(raw, one, "size_x int, size_y int, size_z int")


def default_player(records: DataFrame) -> DataFrame:
    """The record (record, x, z) whose text is the smallest; no row without one."""
    first = records.agg(F.min(F.struct("record", "x", "z")).alias("p"))
    return first.where("p IS NOT NULL").select("p.*")


def world_header(meta: DataFrame, registry: DataFrame, players: DataFrame) -> DataFrame:
    """One row: the world's size, the number of registered codes and the default
    player with its position, null where there is none. An unreadable size is no
    row, a missing player is no failure."""
    player = players.agg(F.min(F.struct("record", "x", "z")).alias("p")).select(F.col("p.record").alias("player"), F.col("p.x").alias("player_x"), F.col("p.z").alias("player_z"))
    codes = registry.agg(F.count(F.lit(1)).alias("registered"))
    return meta.where("error IS NULL").drop("error").join(F.broadcast(codes)).join(F.broadcast(player))  # one row each


def read_diagnostics(rows: DataFrame, limit: int = 10, samples: int = 10) -> DataFrame:
    """kind, reason, n of read rows (id, status, error, liquid_error): one row
    PARSED with all that were read, the most frequent reasons of SKIPPED (IGNORED)
    and FAILED rows, ties by text, the number of LIQUID failures, and LIQUID_SAMPLE
    rows for the first of them by id. A blank reason is unspecified."""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    text = lambda c: F.when(bare(c) == "", "unspecified").otherwise(bare(c))
    parsed = (F.col("status") == "READ") & F.col("error").isNull()
    kind = F.when(F.col("status") == "IGNORED", "SKIPPED").otherwise("FAILED")
    none = F.lit(None).cast("string")
    count = F.count(F.lit(1)).alias("n")
    good = rows.where(parsed).agg(count).select(F.lit("PARSED").alias("kind"), none.alias("reason"), "n")
    bad = rows.where(~parsed).groupBy(kind.alias("kind"), text(F.col("error")).alias("reason")).agg(count)
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "reason"))
    bad = bad.withColumn("place", place).where(F.col("place") <= limit).drop("place")
    wet = rows.where(parsed & F.col("liquid_error").isNotNull())
    total = wet.agg(count).select(F.lit("LIQUID").alias("kind"), none.alias("reason"), "n")
    first = wet.orderBy("id").limit(samples).select(F.lit("LIQUID_SAMPLE").alias("kind"), F.concat(F.lit("liquid decode failed: "), text(F.col("liquid_error"))).alias("reason"), F.lit(1).cast("long").alias("n"))
    return good.unionByName(bad).unionByName(total).unionByName(first)


def mapchunk_status(requested: DataFrame, raw: DataFrame) -> DataFrame:
    """One terminal status for each requested mapchunk (mx, mz):
    PRESENT_DECODED, PRESENT_UNREADABLE or ABSENT, with its heights."""
    read = scan_raw(raw, vertical=False).where("status <> 'IGNORED'")
    heights = decode_heights(read.select(F.col("x").alias("mx"), F.col("z").alias("mz"), "data"))
    joined = requested.select("mx", "mz").distinct().join(heights.withColumn("_there", F.lit(True)), ["mx", "mz"], "left")
    status = F.when(F.col("_there").isNull(), "ABSENT").when(F.col("error").isNull(), "PRESENT_DECODED").otherwise("PRESENT_UNREADABLE")
    return joined.withColumn("read_status", status).drop("_there")
