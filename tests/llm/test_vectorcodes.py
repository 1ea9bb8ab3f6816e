"""Vector codes against brute force and SQL."""

import duckdb
import numpy as np

from loam.llm import vectorcodes as codes
from loam.llm.queries import oracle_sql, queries

SMALL = "/root/testdata/sf0.001"
TABLE = "vec_id long, embedding array<double>, label int, vector string, code int, error int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "v", 1, 2) for r in rows], TABLE)


def brute(rows, parts=16, entries=64, rounds=2):
    vectors = {i: np.floor(256 * np.array(v)).astype(int) for i, v, _ in rows}
    d = len(next(iter(vectors.values()))) // parts
    cut = {i: v.reshape(parts, d) for i, v in vectors.items()}
    books = np.array([cut[i] for i in sorted(cut)[:entries]]).transpose(1, 0, 2)
    near = lambda: {i: [int(((b - p) ** 2).sum(axis=1).argmin()) for b, p in zip(books, c)] for i, c in cut.items()}
    for _ in range(rounds):
        found = near()
        for p in range(parts):
            for e in range(books.shape[1]):
                own = [cut[i][p] for i in cut if found[i][p] == e]
                if own:
                    books[p, e] = np.floor(np.sum(own, axis=0) / len(own))
    found = near()
    error = {i: sum(int(((books[p, e] - cut[i][p]) ** 2).sum()) for p, e in enumerate(found[i])) for i in cut}
    by = {}
    for i, _, label in rows:
        by[label] = by.get(label, 0) + error[i]
    said = codes.digest(books)
    return sorted((i, bytes(found[i]).hex(), error[i], by[label], said) for i, _, label in rows)


def test_as_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 32))
    rows = [(i * 3 - 200, (centres[i % 30] * (i % 7 > 0) + rng.normal(size=32) * [0, 0.01, 0.3, 40][i % 4]).tolist(), [None, 1, 2][i % 3]) for i in range(400)]
    got = sorted(tuple(r) for r in codes.compress(frame(spark, rows).repartition(5)).collect())
    assert got == brute(rows)
    few = rows[:9]
    assert sorted(tuple(r) for r in codes.compress(frame(spark, few)).collect()) == brute(few)


def test_as_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    got = sorted(tuple(r) for r in queries()["op13_vector_codes"](spark, SMALL).collect())
    assert got == sorted(db.execute(oracle_sql()["op13_vector_codes"]).fetchall()) and len(got) > 100


def test_grid_finds_the_nearest_also_where_hashes_meet():
    rng = np.random.default_rng(0)
    for d, spread in ((1, 3), (4, 400), (7, 1 << 20)):
        entries = rng.integers(-spread, spread, (64, d))
        entries[40] = entries[3]
        rows = np.concatenate([rng.integers(-2 * spread, 2 * spread, (500, d)), entries])
        for change in (lambda g: None, lambda g: setattr(g, "mixers", np.zeros(d, np.int64)), lambda g: setattr(g, "shift", 0)):
            grid = codes.Grid(entries)
            change(grid)
            full = ((rows[:, None, :] - entries) ** 2).sum(axis=2)
            for some in (slice(0, 300), slice(200, None)):
                index, distance = grid.nearest(rows[some])
                assert (index == full[some].argmin(axis=1)).all() and (distance == full[some].min(axis=1)).all()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [i / 10 + p for p in range(16)], None) for i in range(5)]
    odd = [(10, None, 1), (11, [nan] + [0.0] * 15, 1), (12, [inf] + [0.0] * 15, 1), (13, [None] + [0.0] * 15, 1), (14, [], 1), (15, [1.0] * 3, 1), (16, [1.0] * 32, 1), (17, [1e300] + [0.0] * 15, 1)]
    got = codes.compress(frame(spark, good + odd)).collect()
    assert sorted(r.vec_id for r in got) == [0, 1, 2, 3, 4] and all(r.error == 0 and r.label_error == 0 for r in got)
    assert codes.compress(frame(spark, [])).count() == 0 and codes.compress(frame(spark, odd[:4])).count() == 0
    twice = codes.compress(frame(spark, [(1, [0.5] * 16, 2), (1, [0.25] * 16, 2), (None, [9.0] * 16, None), (None, [9.0] * 16, None)])).collect()
    assert len(twice) == 4 and sorted(r.code for r in twice) == ["00" * 16] * 2 + ["01" * 16] * 2
    rows = codes.whole_vectors(frame(spark, good))
    books = codes.train(rows)
    back = {r.vec_id: r.embedding for r in codes.decode(codes.encode(rows, books), books).collect()}
    assert all(np.abs(np.array(back[i]) - v).max() < 1 / 256 for i, v, _ in good)
