"""Approximate nearest neighbours by collision counting with virtual rehashing.

Candidates are dealt out in blocks by ranges of their first projection. A block
keeps one sorted array for each random projection. A query opens a window around
its own projection in every array and widens all of them step by step, which
stands for rehashing at coarser widths. A vector that lies in the windows of
enough arrays is verified by its true distance (QALSH, Huang et al. 2015).

A query first searches the block it lies in, widening until the k-th nearest
found lies within the radius that the windows stand for. That distance bounds
all that follows: the query is sent only to the blocks whose range meets its
window, and there one window of that radius is enough.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop, store

K = 10
#: Every vector whose id this divides is a query.
QUERY_EVERY = 100
PROJECTIONS = 32
#: Share of the arrays whose windows must hold a vector before it is verified.
THRESHOLD = 0.7
#: Half width of the windows, in units of the radius they stand for.
REACH = 1.35
GROWTH = 1.25
#: Half width, in units of the k-th distance in the own block, of the window that
#: chooses the other blocks: a neighbour's first projection lies beyond it once in 370.
ROUTE = 3.0
#: Candidates of a block and queries that one task asks of it, about; small tables
#: are cut finer, into up to FEWEST blocks of LEAST_ROWS. Rows alone decide, so the
#: number of cores changes no result.
CANDIDATE_ROWS, LEAST_ROWS, FEWEST = 32768, 4096, 8
QUERY_ROWS = 32768
SEED = 17


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, v): vectors that are not null, not zero and wholly finite."""
    v = F.col(embedding).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.forall(v, finite) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).where(good).select(F.col(vec_id).cast("long").alias("id"), v.alias("v"))


def lines(size: int, projections: int = PROJECTIONS) -> np.ndarray:
    """The random projections of vectors of this length, one to a column."""
    return np.random.default_rng((SEED, size)).normal(size=(size, projections))


def projected(rows: DataFrame) -> DataFrame:
    """rows (key, id, v) with size, the length of v, and at, its first projection."""

    def run(batches):
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column("v")], np.int32)
            at = np.empty(len(sizes))
            for i, v in enumerate(batch.column("v")):
                if sizes[i] not in known:
                    known[sizes[i]] = lines(int(sizes[i]))[:, 0]
                at[i] = v.values.to_numpy() @ known[sizes[i]]
            at = np.nan_to_num(at)  # of huge components
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), pa.array(at)], ["key", "id", "v", "size", "at"])

    return rows.mapInArrow(run, "key long, id long, v array<double>, size int, at double")


class Block:
    """Candidates of one length with a sorted array of each projection."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, vectors: np.ndarray, threshold: float = THRESHOLD):
        self.keys, self.ids, self.vectors = keys, ids, vectors
        self.lines = lines(vectors.shape[1])
        at = (vectors @ self.lines).T
        order = np.argsort(at, axis=1, kind="stable")
        self.sorted = np.take_along_axis(at, order, axis=1)
        self.order = order.astype(np.int32)
        self.rank = np.empty_like(self.order)
        np.put_along_axis(self.rank, order, np.arange(at.shape[1], dtype=np.int32)[None, :], axis=1)
        self.need = int(np.ceil(threshold * PROJECTIONS))
        #: Vectors so long that their projections overflow: no window holds them, so all are verified.
        self.wild = np.flatnonzero(~np.isfinite(at).all(axis=0))
        self.slack = 1e-9 * (1 + float(np.abs(self.sorted[np.isfinite(self.sorted)]).max(initial=0)))

    def colliding(self, at: np.ndarray, reach: float) -> np.ndarray:
        """The candidates whose places lie in the windows of enough arrays, and those
        that have none; all, where the query or the window has no end."""
        if not (np.isfinite(at).all() and np.isfinite(reach)):
            return np.arange(len(self.ids))
        found = self._in_windows(at, reach)
        return np.union1d(found, self.wild) if len(self.wild) else found

    def _in_windows(self, at: np.ndarray, reach: float) -> np.ndarray:
        low = np.array([np.searchsorted(s, x - reach - self.slack, "left") for s, x in zip(self.sorted, at)], np.int32)
        high = np.array([np.searchsorted(s, x + reach + self.slack, "right") for s, x in zip(self.sorted, at)], np.int32)
        width = high - low
        if 4 * int(width.sum()) < len(self.ids):  # few places: count them alone
            held = np.concatenate([o[a:b] for o, a, b in zip(self.order, low, high)])
            found, hits = np.unique(held, return_counts=True)
            return found[hits >= self.need]
        inside = (self.rank - low[:, None]).view(np.uint32) < width[:, None].astype(np.uint32)
        return np.flatnonzero(inside.sum(axis=0, dtype=np.uint8) >= self.need)

    def _verified(self, new: np.ndarray, key: int, query: np.ndarray):
        new = new[self.keys[new] != key]
        return _distances(self.vectors[new], query), self.ids[new]

    def nearest(self, key: int, query: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) of the k nearest found, ties to the smaller id, by
        widening windows; the row of this key is left out."""
        at = query @ self.lines
        gaps = [self._gap(s, x, k) for s, x in zip(self.sorted, at)]
        radius = float(np.median(gaps)) / REACH
        radius = max(radius, self.slack) if np.isfinite(radius) else np.inf
        seen = np.zeros(len(self.ids), bool)
        d, ids = np.empty(0), np.empty(0, np.int64)
        while True:
            new = self.colliding(at, REACH * radius)
            new = new[~seen[new]]
            if len(new):
                seen[new] = True
                more_d, more_ids = self._verified(new, key, query)
                d, ids = nearest_of(np.concatenate([d, more_d]), np.concatenate([ids, more_ids]), k)
            # the k-th lies inside the radius, or all rows of the block are verified
            if len(d) == k and d[-1] <= radius or seen.all():
                return d, ids
            radius *= GROWTH

    def within(self, key: int, query: np.ndarray, bound: float, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest found within the bound, by one window of that radius."""
        if not np.isfinite(bound):
            return self.nearest(key, query, k)
        d, ids = self._verified(self.colliding(query @ self.lines, REACH * bound), key, query)
        near = d <= bound
        return nearest_of(d[near], ids[near], k)

    @staticmethod
    def _gap(line: np.ndarray, x: float, k: int) -> float:
        i = int(np.clip(np.searchsorted(line, x), 0, len(line) - 1))
        a, b = max(0, i - k), min(len(line) - 1, i + k)
        return min(abs(x - line[a]), abs(line[b] - x))


def _distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances; components whose squares overflow are scaled first."""
    with np.errstate(over="ignore", invalid="ignore"):
        away = vectors - query
        d = np.sqrt((away * away).sum(axis=1))
        far = np.flatnonzero(~np.isfinite(d))
        if len(far):
            half = vectors[far] / 2 - query / 2  # the difference itself may overflow
            most = np.abs(half).max(axis=1)
            d[far] = 2 * (most * np.sqrt(((half / most[:, None]) ** 2).sum(axis=1)))
    return d


def nearest_of(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest by distance, then id."""
    if len(d) > 4 * k:
        some = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
        d, ids = d[some], ids[some]
    best = np.lexsort((ids, d))[:k]
    return d[best], ids[best]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64, copy=False)


def blocked(vectors: DataFrame, block_rows: int = CANDIDATE_ROWS) -> tuple[DataFrame, str]:
    """The index table (key, id, v, size, at, block) and its path: rows numbered by
    key, in blocks of about that many by length and first projection. Rows that
    repeat a vector are dealt out by key, so no block holds all copies."""
    spark = vectors.sparkSession
    rows, rows_path = store(projected(usable(vectors).select(F.monotonically_increasing_id().alias("key"), "id", "v")), "vectors")
    n = rows.count()
    blocks = max(1, -(-n // block_rows), min(FEWEST, -(-n // LEAST_ROWS)))
    ranged = rows.repartitionByRange(blocks, "size", "at", "key").withColumn("block", F.spark_partition_id())
    table, path = store(ranged, "blocks")
    drop(spark, rows_path)
    return table, path


def nearest_neighbours(
    vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY, threshold: float = THRESHOLD, block_rows: int = CANDIDATE_ROWS, query_rows: int = QUERY_ROWS
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found.

    Queries are the rows whose id query_every divides, candidates all rows but
    the query's own. score is the Euclidean distance in double precision. Null,
    zero and non-finite vectors take no part, nor do vectors of another length
    than the query's. With fewer candidates than k all are returned. Rows that
    repeat a vec_id are rows like any other: each is a candidate, and each of a
    query's is answered on its own. Empty input gives no rows.
    """
    table, _ = blocked(vectors, block_rows)
    is_query = F.col("id") % query_every == 0
    bounds, _ = store(table.groupBy("block", "size").agg(F.min("at").alias("low"), F.max("at").alias("high")), "bounds")

    def search_own(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size, part in rows.groupby("size"):
            asked = part[part["id"] % query_every == 0]
            if not len(asked):
                continue
            block = Block(part["key"].to_numpy(), part["id"].to_numpy(), _matrix(part["v"]), threshold)
            for key, query_id, at, v in zip(asked["key"], asked["id"], asked["at"], asked["v"]):
                d, ids = block.nearest(key, np.asarray(v), k)
                out.append((key, query_id, rows["block"].iat[0], size, at, v, d[-1] if len(d) == k else np.inf, ids, d))
        return pd.DataFrame(out, columns=["key", "query_id", "own", "size", "at", "v", "bound", "ids", "scores"])

    # blocks without a query need no search of their own
    with_query = table.where(is_query).select("block").distinct()
    first = table.join(with_query, "block", "left_semi").groupBy("block")
    own, _ = store(first.applyInPandas(search_own, "key long, query_id long, own int, size int, at double, v array<double>, bound double, ids array<long>, scores array<double>"), "own")

    # each query goes to the other blocks that its window meets, in parts that one task can hold
    parts = max(1, -(-own.count() // query_rows))
    reach = F.col("bound") * ROUTE + (1 + F.abs("at")) * 1e-9
    meets = (F.col("block") != F.col("own")) & (F.col("low") <= F.col("at") + reach) & (F.col("high") >= F.col("at") - reach)
    asked = own.select("key", "query_id", "own", "size", "at", "v", "bound").join(bounds, "size").where(meets)
    asked = asked.select("block", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"), "key", "query_id", "size", "v", "bound")
    sent = table.select("block", "key", "id", "size", "v").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def search(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size, part in queries.groupby("size"):
            held = candidates[candidates["size"] == size]
            if not len(held):
                continue
            block = Block(held["key"].to_numpy(), held["id"].to_numpy(), _matrix(held["v"]), threshold)
            for key, query_id, v, bound in zip(part["key"], part["query_id"], part["v"], part["bound"]):
                d, ids = block.within(key, np.asarray(v), bound, k)
                out.append(pd.DataFrame({"key": key, "query_id": query_id, "vec_id": ids, "score": d}))
        return pd.concat(out) if out else pd.DataFrame({"key": [], "query_id": [], "vec_id": [], "score": []})

    shape = "key long, query_id long, vec_id long, score double"
    others = sent.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(search, shape)
    near = own.select("key", "query_id", F.explode(F.arrays_zip("ids", "scores")).alias("f")).select("key", "query_id", F.col("f.ids").alias("vec_id"), F.col("f.scores").alias("score"))
    best = Window.partitionBy("key").orderBy("score", "vec_id")
    found = near.unionByName(others).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
