"""The resource index as one publication, arriving payloads, and saves in pages."""

import json
import sqlite3

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loam.functions import geometry as G
from loam.operators.tables import first_kept, known_absent
from loam.sources import decode, payloads, published, savefile
from loam.sources import tables as T
from loam.streaming import refresh

def of(text):
    """A schema without a session: "name type, ..", types int, long and string."""
    out = StructType()
    for field in text.split(", "):
        name, kind = field.split(" ")
        out.add(name, {"int": "integer"}.get(kind, kind))
    return out


KEYS = "cx int, cy int, cz int"
OCC, COV = of(f"{KEYS}, block_id int, lx int, lz int, y_mask long"), of(f"{KEYS}, status string")
ARRIVED = of(f"{KEYS}, status string, event_id long")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def index_of(spark, path, coverage=COV):
    return [rows(published.read(spark, path, name, schema).drop("rx", "rz")) for name, schema in ((T.OCCURRENCES, OCC), (T.COVERAGE, coverage))]


def test_index_round_trip_replacement_and_duplicates(spark, tmp_path):
    path = str(tmp_path / "index")
    assert index_of(spark, path) == [[], []]
    copper = (1, 0, 2, 2, 7, 9, 1 << 2 | 1 << 5)
    cov = [(1, 0, 2, "AVAILABLE"), (2, 0, 2, "AVAILABLE"), (3, 0, 2, "MISSING"), (40, 0, 2, "FAILED")]
    lost = [(3, 0, 2, 2, 0, 0, 1), (40, 0, 2, 2, 0, 0, 1), (9, 9, 9, 2, 0, 0, 1)]  # of chunks that are not available, or not published
    T.write_resource_index(spark.createDataFrame([copper, *lost], OCC), spark.createDataFrame(cov, COV), path)
    assert index_of(spark, path) == [[copper], sorted(cov, key=repr)]
    with pytest.raises(ValueError):
        T.write_resource_index(spark.createDataFrame([copper], OCC), spark.createDataFrame([(1, 0, 2, "AVAILABLE"), (1, 0, 2, "MISSING")], COV), path)
    assert index_of(spark, path) == [[copper], sorted(cov, key=repr)]
    # a chunk that is published again loses what was stored of it, its neighbours nothing
    T.write_resource_index(spark.createDataFrame([], OCC), spark.createDataFrame([(1, 0, 2, "FAILED")], COV), path)
    T.write_resource_index(spark.createDataFrame([(2, 0, 2, 3, 1, 1, 8)], OCC), spark.createDataFrame([(2, 0, 2, "AVAILABLE")], COV), path)
    assert index_of(spark, path) == [[(2, 0, 2, 3, 1, 1, 8)], sorted([(1, 0, 2, "FAILED"), *cov[1:]], key=repr)]
    assert published.vacuum(spark, path, (T.OCCURRENCES, T.COVERAGE)) > 0
    assert index_of(spark, path) == [[(2, 0, 2, 3, 1, 1, 8)], sorted([(1, 0, 2, "FAILED"), *cov[1:]], key=repr)]


def test_a_failure_between_the_tables_leaves_the_old_index(spark, tmp_path):
    path = str(tmp_path / "index")
    old = [(1, 0, 2, 2, 7, 9, 4)], [(1, 0, 2, "AVAILABLE")]
    T.write_resource_index(spark.createDataFrame(old[0], OCC), spark.createDataFrame(old[1], COV), path)
    version = published.current(spark, path)
    region = {"rx": F.lit(0), "rz": F.lit(0)}
    good = spark.createDataFrame([(1, 0, 2, 5, 0, 0, 1)], OCC).withColumns(region)
    bad = spark.createDataFrame([(1, 0, 2, "AVAILABLE")], COV).withColumn("status", F.raise_error(F.lit("lost")).cast("string")).withColumns(region)
    with pytest.raises(Exception, match="lost"):
        published.publish(spark, path, {T.OCCURRENCES: good, T.COVERAGE: bad}, good)
    assert published.current(spark, path) == version and index_of(spark, path) == [list(old[0]), list(old[1])]
    T.write_resource_index(spark.createDataFrame([(1, 0, 2, 6, 0, 0, 1)], OCC), spark.createDataFrame(old[1], COV), path)
    assert index_of(spark, path)[0] == [(1, 0, 2, 6, 0, 0, 1)]
    assert index_of(spark, path)[0] != rows(published.read(spark, path, T.OCCURRENCES, OCC, version=version).drop("rx", "rz"))


def test_reading_an_index_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "index")
    many = spark.createDataFrame([(16 * i, 0, 0, "AVAILABLE") for i in range(6)], COV)
    T.write_resource_index(spark.createDataFrame([], OCC), many, path)
    wanted = spark.createDataFrame([(2, 0)], "rx int, rz int")
    read = published.read(spark, path, T.COVERAGE, COV, wanted)
    assert rows(read) == [(32, 0, 0, "AVAILABLE", 2, 0)] and "dynamicpruning" in read._jdf.queryExecution().toString()


def payload(*cells):
    blocks = np.zeros(payloads.CELLS, np.int32)
    for (x, y, z), block in cells:
        blocks[(y * 32 + z) * 32 + x] = block
    return payloads.put_chunk(blocks)


def test_arriving_payloads_end_in_the_index_of_a_batch_run(spark, tmp_path):
    registry = spark.createDataFrame([(0, "game:air"), (1, "game:rock-granite"), (5, "game:ore-poor-nativecopper-granite")], "block_id int, code string")
    key = lambda x, y, z, dim=0: x | z << 27 | dim << 22 | y << 54
    new, old = payload(((1, 2, 3), 5), ((1, 4, 3), 5), ((0, 0, 0), 1)), payload(((9, 9, 9), 5))
    arrivals = [
        (1, key(0, 0, 0), old, 0), (4, key(0, 0, 0), new, 1), (2, key(0, 0, 0), old, 2),  # twice in all, once too late
        (5, key(1, 0, 0), new, 0), (6, key(1, 0, 0), new[:30], 2),  # the last delivery is broken
        (7, key(20, 1, 0), new, 1), (8, key(2, 0, 0), payload(((0, 0, 0), 1)), 1), (9, key(3, 0, 0), b"", 1),
        (10, key(0, 0, 0, 1), new, 1), (11, key(0, 0, 0) | 1 << 21, new, 1), (12, key(5, 0, 0), old, 3), (12, key(5, 0, 0), old, 3)]
    schema = "event_id long, position long, data binary, part int"
    frame, size = spark.createDataFrame([(e, p, bytearray(d), n) for e, p, d, n in arrivals], schema), (700, 64, 32)
    for n in range(4):
        frame.where(f"part = {n}").drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "arrivals"))
    path, whole = str(tmp_path / "index"), str(tmp_path / "whole")
    stream = spark.readStream.schema(frame.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "arrivals"))
    refresh.stream_index(stream, registry, size, path, str(tmp_path / "checkpoint")).awaitTermination()
    want = index_of(spark, path, ARRIVED)
    assert want[1] == [(0, 0, 0, "AVAILABLE", 4), (1, 0, 0, "FAILED", 6), (2, 0, 0, "AVAILABLE", 8), (20, 1, 0, "AVAILABLE", 7), (3, 0, 0, "FAILED", 9), (5, 0, 0, "AVAILABLE", 12)]
    assert want[0] == [(0, 0, 0, 5, 1, 3, 1 << 2 | 1 << 4), (20, 1, 0, 5, 1, 3, 1 << 2 | 1 << 4), (5, 0, 0, 5, 9, 9, 1 << 9)]
    refresh.index_chunks(frame.drop("part"), registry, size, whole)
    assert index_of(spark, whole, ARRIVED) == want
    # a batch that comes again, by number or in other company, changes nothing
    before = published.current(spark, path)
    refresh.index_chunks(frame.drop("part"), registry, size, path, 1)
    refresh.index_chunks(frame.where("part < 2").drop("part"), registry, size, path)
    assert published.current(spark, path) == before and published.noted(spark, path, 0) and not published.noted(spark, path, 99)
    # the world's edge cuts blocks off
    narrow = str(tmp_path / "narrow")
    refresh.index_chunks(frame.where("event_id = 4").drop("part"), registry, (64, 4, 64), narrow)
    assert index_of(spark, narrow, ARRIVED)[0] == [(0, 0, 0, 5, 1, 3, 1 << 2)]


def test_unfolded_chunks_are_neither_stored_nor_held(spark, tmp_path, monkeypatch):
    """Full chunks: what is stored is as small as payloads, and voxels leave chunk by chunk."""
    registry = spark.createDataFrame([(1, "game:rock-granite"), (5, "game:ore-poor-nativecopper-granite")], "block_id int, code string")
    full, plain = np.resize(np.array([5, 1, -7], np.int32), payloads.CELLS), np.ones(payloads.CELLS, np.int32)
    raw = [(n, n % 50 | n // 50 << 27, bytearray(payloads.put_chunk(plain if n % 5 == 4 else full))) for n in range(100)]
    raw += [(100, 60, bytearray(payloads.put_chunk(full)[:-9])), (101, 61, bytearray(payloads.put(15, 1)))]
    stored, store = [], refresh.store
    monkeypatch.setattr(refresh, "store", lambda df, name, **k: stored.append(df.schema) or store(df, name, **k))
    path, frame = str(tmp_path / "index"), spark.createDataFrame(raw, "event_id long, position long, data binary").coalesce(1)
    refresh.index_chunks(frame, registry, (4096, 32, 4096), path)
    assert stored and not any("array" in f.dataType.simpleString() for schema in stored for f in schema)
    occurrences, coverage = index_of(spark, path, ARRIVED)
    want = {(at % 32, at // 32 % 32): 0 for at in range(1024)}
    for at in np.flatnonzero(full == 5).tolist():
        want[at % 32, at // 32 % 32] |= 1 << at // 1024
    assert occurrences == sorted(((n % 50, 0, n // 50, 5, x, z, m) for n in range(100) if n % 5 != 4 for (x, z), m in want.items()), key=repr)
    assert coverage == sorted([(n % 50, 0, n // 50, "AVAILABLE", n) for n in range(100)] + [(60, 0, 0, "FAILED", 100), (61, 0, 0, "FAILED", 101)], key=repr)
    whole = frame.where("event_id < 100").select((F.col("event_id") % 50).cast("int").alias("cx"), F.lit(1).alias("cy"), F.lit(2).alias("cz"), "data")
    voxels = decode.raw_voxels(whole)
    assert voxels.groupBy(F.expr("x div 32"), F.expr("y div 32"), F.expr("z div 32")).count().count() == 50
    assert rows(voxels.exceptAll(decode.chunk_voxels(decode.decode_chunk(whole))).limit(1)) == [] and voxels.count() == 100 * payloads.CELLS
    most = voxels.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long")
    assert voxels.where("block_id = -7").count() == 80 * int((full == -7).sum()) and most.agg(F.max("n")).first()[0] <= decode.UNFOLDED


def test_first_delivery_is_kept(spark):
    df = spark.createDataFrame([(1, 9, "late"), (1, 3, "first"), (2, 5, "only"), (1, 3, "third")], "k int, event_id long, status string")
    assert rows(first_kept(df, ["k"], ["event_id"])) == [(1, 3, "first", 2), (2, 5, "only", 0)]


def save(path, keys, table="mapchunk"):
    with sqlite3.connect(path) as db:
        db.execute(f"CREATE TABLE {table} (position INTEGER PRIMARY KEY, data BLOB)")
        db.executemany(f"INSERT INTO {table} VALUES (?, ?)", [(k, b"x") for k in keys])


def pages_of(spark, path, page):
    spark.dataSource.register(savefile.SaveFile)
    return spark.readStream.format("loam_save").options(table="mapchunk", page=page).load(str(path))


def run(query):
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_discovery_resumes_reads_no_key_twice_and_marks_the_end(spark, tmp_path):
    key = lambda mx, mz, dim=0: mx | mz << 27 | dim << 22
    (tmp_path / "saves").mkdir()
    first, second = [key(x, z) for x in range(10) for z in range(3)] + [key(1, 1, 3)], [key(x, 7) for x in range(4)]
    save(tmp_path / "saves" / "a.db", first)
    save(tmp_path / "saves" / "b.db", second)
    save(tmp_path / "saves" / "empty.db", [])
    path, checkpoint, seen = str(tmp_path / "catalog"), str(tmp_path / "checkpoint"), []

    def batch(df, number):
        if len(seen) == 2 and not run.resumed:
            raise RuntimeError("stopped")
        got = df.collect()
        seen.append(got)
        refresh.discover(df, path)

    run.resumed = False
    query = pages_of(spark, tmp_path / "saves", 8).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
    with pytest.raises(Exception, match="stopped"):
        run(query)
    assert len(seen) == 2 and spark.read.parquet(f"{path}/complete").first().complete is False
    asked = spark.createDataFrame([("a", 0, 0), ("a", 9, 2), ("a", 50, 50)], "world string, mx int, mz int")
    catalog = lambda: spark.read.parquet(f"{path}/keys")
    absent = lambda: rows(known_absent(asked, catalog(), spark.read.parquet(f"{path}/complete"), ["world", "mx", "mz"]))
    assert absent() == []  # nothing is proven absent before the end
    run.resumed = True
    run(pages_of(spark, tmp_path / "saves", 8).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start())
    keys = [(r.world, r.position) for got in seen for r in got if r.position is not None]
    assert sorted(keys) == sorted([("a", k) for k in first] + [("b", k) for k in second])
    ends = [[r.position is None for r in got].count(True) for got in seen]
    assert ends[-1] == 1 and sum(ends) == 1 and all(len(got) <= 16 for got in seen) and len(seen) == 4
    assert rows(catalog()) == sorted([("a", x, z) for x in range(10) for z in range(3)] + [("b", x, 7) for x in range(4)], key=repr)
    assert absent() == [("a", 50, 50)]
    # what is added later is read as further pages
    with sqlite3.connect(tmp_path / "saves" / "b.db") as db:
        db.execute("INSERT INTO mapchunk VALUES (?, ?)", (key(50, 50), b"x"))
    run(refresh.stream_discovery(pages_of(spark, tmp_path / "saves", 8), path, checkpoint))
    assert ("b", 50, 50) in rows(catalog()) and spark.read.parquet(f"{path}/complete").first().complete


def test_discovery_of_an_empty_save_ends(spark, tmp_path):
    save(tmp_path / "none.db", [])
    run(refresh.stream_discovery(pages_of(spark, tmp_path / "none.db", 5), str(tmp_path / "c"), str(tmp_path / "o")))
    assert spark.read.parquet(str(tmp_path / "c/complete")).first().complete and spark.read.parquet(str(tmp_path / "c/keys")).count() == 0


def test_splits_are_balanced_wherever_keys_lie(spark, tmp_path):
    keys = [y << 54 | n for y in range(8) for n in range(1024)]  # eight levels far apart
    save(tmp_path / "w.db", keys, "chunk")
    for asked in (1, 8, 64, 200):
        reader = savefile.SaveReader({"path": str(tmp_path / "w.db"), "partitions": str(asked)})
        parts = reader.partitions()
        sizes = [sum(1 for _ in reader.read(p)) for p in parts]
        assert len(parts) == asked and sum(sizes) == len(keys) and max(sizes) <= 2 * len(keys) / asked
    assert len(savefile.SaveReader({"path": str(tmp_path / "w.db"), "partitions": "20000"}).partitions()) == len(keys)


def test_conditions_on_position_are_pushed_down(spark, tmp_path):
    save(tmp_path / "w.db", range(0, 30000, 3), "chunk")
    spark.dataSource.register(savefile.SaveFile)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        load = lambda: spark.read.format("loam_save").options(table="chunk", pushdown="true").load(str(tmp_path / "w.db"))
        for condition in ("position = 9", "position IN (3, 4, 299, 300, 12000)", "position > 100 AND position <= 130", "position >= 29990 AND length(data) = 1", "position < 0", "position IN (3, 6) AND position > 3"):
            got = load().where(condition)
            assert rows(got.select("position")) == rows(load().select("position").withColumn("data", F.lit("x")).where(condition).select("position")), condition
        reader = savefile.PushedReader({"path": str(tmp_path / "w.db")})
        from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains

        kept = list(reader.pushFilters([In(("position",), (3, 6, 9, 10)), GreaterThan(("position",), 3), StringContains(("world",), "w"), EqualTo(("data",), 5)]))
        assert len(kept) == 2 and sorted(k for p in reader.partitions() for k in p.listed) == [6, 9, 10]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_payloads_are_left_where_only_keys_are_asked(spark, tmp_path):
    save(tmp_path / "w.db", [1, 2], "chunk")
    spark.dataSource.register(savefile.SaveFile)
    got = spark.read.format("loam_save").options(table="chunk", payload="false").load(str(tmp_path / "w.db"))
    assert rows(got.select("position", "data")) == [(1, None), (2, None)]


def test_saves_of_many_worlds(spark, tmp_path):
    df = spark.createDataFrame([(w, k, bytearray(b"d")) for w in ("p", "q") for k in (1, 5, 5)], "world string, position long, data binary")
    savefile.write_saves(df, str(tmp_path / "s"))
    spark.dataSource.register(savefile.SaveFile)
    got = spark.read.format("loam_save").option("table", "mapchunk").load(str(tmp_path / "s"))
    assert rows(got.select("world", "position")) == [("p", 1), ("p", 5), ("q", 1), ("q", 5)]
    assert json.loads(json.dumps(savefile.SaveStream({"path": str(tmp_path / "s"), "table": "mapchunk", "page": "1"}).latestOffset())) == {"keys": {"p.db": 1, "q.db": 1}, "complete": False}
    assert G.CHUNK == 32
