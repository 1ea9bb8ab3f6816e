"""Vector codes: each part of a vector as the index of its nearest codebook entry.

Components are whole numbers, so distances are exact. Finding the nearest entry
of a part goes by memoised grid cells: the part's coarse cell is hashed; an entry
whose least distance to the cell's box exceeds another entry's greatest distance
can't be nearest to anything in the box, and the entries left after that are kept
for the cell. Only they are evaluated for the parts that lie in it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dims import small
from .shared import store

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: A component x stands for floor(SCALE * x).
SCALE = 256
#: Vectors with a component beyond this take no part: squares must fit a long.
MOST = 1 << 24
#: Cells that a part keeps; it starts anew when they are as many.
KNOWN = 1 << 14
_TOGETHER = 1 << 21  # components that are held at once when boxes are compared


class Grid:
    """The entries (k, d) of one part position, and the cells met so far."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.asarray(entries, np.int64)
        span = int((self.entries.max(axis=0) - self.entries.min(axis=0)).max(initial=0))
        self.shift = max(0, span.bit_length() - 5)  # a cell is 1/32 to 1/16 of the span wide
        d = self.entries.shape[1]
        # odd multipliers of a multiplicative hash; cells that share a hash are told apart
        self.mixers = (np.arange(1, d + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)).view(np.int64)
        self.known: dict[int, tuple[tuple, np.ndarray]] = {}
        self.evaluated = 0

    def candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each cell the entries that no other one dominates across its box."""
        out, step = [], max(1, _TOGETHER // max(1, self.entries.size))
        for at in range(0, len(cells), step):
            low = (cells[at : at + step] << self.shift)[:, None, :]
            below, above = low - self.entries, self.entries - (low + (1 << self.shift) - 1)
            near = np.maximum(np.maximum(below, above), 0)
            far = np.maximum(np.abs(below), np.abs(above))
            least, most = (near * near).sum(axis=2), (far * far).sum(axis=2)
            out += [np.flatnonzero(keep) for keep in least <= most.min(axis=1, keepdims=True)]
        return out

    def _lookup(self, keys: np.ndarray, cells: np.ndarray) -> list[np.ndarray]:
        tuples, keys = [tuple(c) for c in cells.tolist()], keys.tolist()
        if len(self.known) + len(keys) > KNOWN:
            self.known = {}
        found = [self.known.get(k) for k in keys]
        new = [i for i, f in enumerate(found) if f is None or f[0] != tuples[i]]
        for i, entries in zip(new, self.candidates(cells[new])):
            found[i] = self.known[keys[i]] = (tuples[i], entries)
        return [f[1] for f in found]

    def _exact(self, rows: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest of the chosen entries (r, c) of each row; of equals the first."""
        index, distance = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        step = max(1, _TOGETHER // max(1, chosen.shape[1] * rows.shape[1]))
        for at in range(0, len(rows), step):
            some = slice(at, at + step)
            diff = rows[some, None, :] - self.entries[chosen[some]]
            squares = (diff * diff).sum(axis=2)
            best = squares.argmin(axis=1)[:, None]
            index[some] = np.take_along_axis(chosen[some], best, 1)[:, 0]
            distance[some] = np.take_along_axis(squares, best, 1)[:, 0]
        self.evaluated += chosen.size
        return index, distance

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry to each row (n, d);
        ties go to the lower index."""
        cells = rows >> self.shift
        _, first, cell = np.unique((cells * self.mixers).sum(axis=1), return_index=True, return_inverse=True)
        shown = cells[first]
        lists = self._lookup((shown * self.mixers).sum(axis=1), shown)
        index, distance = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        alike = (cells == shown[cell]).all(axis=1)
        sizes = np.array([len(x) for x in lists], np.int64)
        for size in np.unique(sizes):
            which = np.flatnonzero(sizes == size)
            place = np.full(len(lists), -1)
            place[which] = np.arange(len(which))
            at = np.flatnonzero((place[cell] >= 0) & alike)
            index[at], distance[at] = self._exact(rows[at], np.stack([lists[i] for i in which])[place[cell[at]]])
        odd = np.flatnonzero(~alike)
        if len(odd):
            index[odd], distance[odd] = self._exact(rows[odd], np.tile(np.arange(len(self.entries)), (len(odd), 1)))
        return index, distance


def _parts(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """The vectors of a batch as (rows, parts, d)."""
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(batch.num_rows, parts, -1)


def whole_vectors(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """vec_id, label, vector (whole numbers) of the rows that take part.

    Rows drop out whose vector is null, holds null or a component that is not
    finite or beyond MOST, or is not of the length that most others have among the
    multiples of parts (ties: the shorter). Reads the table twice.
    """
    long = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * scale)
    fine = F.forall(long, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < MOST))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label"), long.alias("vector")).where(F.col("vector").isNotNull() & fine & (F.size("vector") > 0) & (F.size("vector") % parts == 0))
    counts = rows.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    usual = counts.orderBy(F.desc("n"), "length").first()
    kept = rows.where(F.size("vector") == (usual.length if usual else 0))
    return kept.withColumn("vector", F.transform("vector", lambda x: F.floor(x).cast("int")))


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, d) of rows (vec_id, vector).

    They start as the vectors of the smallest vec_ids, a null one last, of a
    repeated one the smallest vector. Each round assigns every part and replaces
    each entry by the floor of its parts' mean. Fewer vec_ids than entries make
    smaller codebooks; no rows make empty ones. The driver sees entries vectors
    and their sums only.
    """
    ids = [r.vec_id for r in rows.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()]
    wanted = F.col("vec_id").isin([i for i in ids if i is not None]) | (F.col("vec_id").isNull() if None in ids else F.lit(False))
    first = rows.where(wanted).groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy(F.col("vec_id").asc_nulls_last()).collect()
    books = np.array([r.vector for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2) if first else np.zeros((parts, 0, 0), np.int64)
    for _ in range(rounds if first else 0):
        books = _improved(rows, books)
    return books


def _improved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    parts, entries, d = books.shape

    def sums(batches):
        grids = [Grid(b) for b in books]
        total, n = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _parts(batch, parts)
            for p, grid in enumerate(grids):
                index, _ = grid.nearest(values[:, p])
                n[p] += np.bincount(index, minlength=entries)
                for i in range(d):  # below 2^53 inside a batch, so exact
                    total[p, :, i] += np.bincount(index, values[:, p, i], entries).astype(np.int64)
        used = np.flatnonzero(np.repeat(n.ravel(), d))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total.ravel()[used]), pa.array(np.repeat(n.ravel(), d)[used])], ["slot", "total", "n"])

    found = rows.select("vector").mapInArrow(sums, "slot long, total long, n long").groupBy("slot").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    flat = books.ravel().copy()
    for r in found.collect():  # one row for each component of the codebooks
        flat[r.slot] = r.total // r.n
    return flat.reshape(books.shape)


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows (.., vector) with code, two hex digits for each part's entry, and
    error, the squared distances summed; vector goes, other columns stay."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    kept = [f for f in rows.schema if f.name not in ("vector", "code", "error")]
    names = [f.name for f in kept]

    def run(batches):
        grids = [Grid(b) for b in books if b.size]  # none without rows
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _parts(batch, len(grids))
            codes, error = np.zeros((batch.num_rows, len(grids)), np.uint8), np.zeros(batch.num_rows, np.int64)
            for p, grid in enumerate(grids):
                index, distance = grid.nearest(values[:, p])
                codes[:, p] = index
                error += distance
            text = pa.array([c.tobytes().hex() for c in codes], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], text, pa.array(error)], [*names, "code", "error"])

    return rows.select(*names, "vector").mapInArrow(run, StructType([*kept, StructField("code", StringType()), StructField("error", LongType())]))


def decode(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """codes (.., code) with embedding, the vector that a code stands for."""

    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series([(np.concatenate([b[i] for b, i in zip(books, bytes.fromhex(t))]) / scale).astype(np.float32) for t in texts])

    return codes.withColumn("embedding", F.pandas_udf(vectors, "array<float>")("code"))


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row of vectors
    (vec_id, embedding, label) that takes part; see whole_vectors() and train().

    Repeated rows each get a row. label_error sums the error over equal labels,
    null being one of them; null where it exceeds a long. No rows give none;
    further columns are ignored. Whole vectors and codes are stored in the shared
    folder; the sums of labels are broadcast only if they are few.
    """
    rows, _ = store(whole_vectors(vectors), "vectors")
    books = train(rows)
    coded, _ = store(encode(rows, books), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long")
    sums, _ = store(coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error")), "labels")
    joined = coded.join(small(sums), F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    """The assignment to the codebooks of round k, and those after it."""
    return f"""
near{k} AS MATERIALIZED (SELECT id, s.p, arg_min(e, (q, e)) AS e, min(q) AS q FROM (
    SELECT id, s.p, b.e, list_sum(list_transform(range(1, len(s.part) + 1), lambda i: (s.part[i] - b.part[i]) * (s.part[i] - b.part[i])))::BIGINT AS q
    FROM parts s JOIN book{k} b ON b.p = s.p) s GROUP BY id, s.p),
mean{k} AS (SELECT p, e, list(total ORDER BY i) AS part FROM (
    SELECT n.p, e, i, floor(sum(part[i]::HUGEINT) / count(*)::DOUBLE)::BIGINT AS total FROM near{k} n JOIN parts s ON s.id = n.id AND s.p = n.p, unnest(range(1, len(part) + 1)) u(i) GROUP BY ALL) m GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.part, b.part) AS part FROM book{k} b LEFT JOIN mean{k} m ON m.p = b.p AND m.e = b.e)"""


#: For DuckDB; takes all vectors to be of one length, and each vec_id to stand once.
SQL = f"""
WITH kept AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT id, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS part FROM kept, range(0, {PARTS}) r(p)),
book0 AS MATERIALIZED (SELECT p, e, part FROM parts JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS e FROM (SELECT id FROM kept ORDER BY id LIMIT {ENTRIES})) f USING (id)),
{",".join(_round_sql(k) for k in range(ROUNDS + 1))},
coded AS (SELECT id, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(q)::BIGINT AS error FROM near{ROUNDS} GROUP BY id),
said AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) AS digest FROM (SELECT p, e, unnest(part) AS x, unnest(range(len(part))) AS i FROM book{ROUNDS}))
SELECT id AS vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256 FROM coded JOIN kept USING (id), said"""
