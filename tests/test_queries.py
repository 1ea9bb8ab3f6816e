"""A choice of registered queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

from loam.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOICE = ["a1_ore_columns", "a3_upper_rock", "a13_signal_relative", "c6_surface_class", "g8_plan_chunks", "j10_neighbours4", "p4_resolve_surface", "p10_prospecting", "r4_terrain_argb", "d5_decode_chunk", "t2_stream_index", "k1_components8", "u6_key_runs"]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return float(v) if type(v).__name__ == "Decimal" else v


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("name", CHOICE)
def test_same_rows(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = registry.queries()[name](spark, DIR)
    want = db.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    a = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=repr)
    b = sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)
    assert a == b
