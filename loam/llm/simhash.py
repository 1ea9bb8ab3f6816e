"""Near-duplicates by SimHash and covering locality-sensitive hashing.

Each of the 64 bits has one of the 15 nonzero vectors of four bits; table v
keeps the bits whose vector has an odd product with v. The vectors of at most
three differing bits span at most three dimensions, so some v is orthogonal to
all of them and its table keeps none of those bits: every pair within the
radius meets in some table (Pagh 2016).

Documents meet by their distinct fingerprint first, so copies cost nothing
further on. A bucket of many different fingerprints is dealt out once more by
the same scheme over the bits its table leaves out; such a second bucket can
hold at most 2^16 of them. Inside a bucket only the links of a spanning forest
leave the task, which keeps the components whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, scope, store

RADIUS = 3
SHINGLE = 3
#: A bucket with more fingerprints than this is dealt out by a second table.
WIDE = 4096
#: Shingles counted at once, which bounds the memory for a very long text.
BLOCK = 1 << 16
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_FULL = (1 << 64) - 1


def _odd(x: int) -> bool:
    return bin(x).count("1") % 2 == 1


def masks(bits: list[int]) -> list[int]:
    """The 15 masks over these bit positions, for the vectors 1 to 15."""
    return [sum(1 << b for i, b in enumerate(bits) if _odd((1 + i % 15) & v)) for v in range(1, 16)]


MASKS = masks(list(range(64)))
#: For each table, the masks of its second tables, which keep its own bits too.
FINER = [[m | own for m in masks([b for b in range(64) if not m0 >> b & 1])] for m0 in MASKS for own in [m0]]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text's word shingles; 0 without words."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - shingle + 1)
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    starts, digest, set_, total = starts[:n].tolist(), xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
    for at in range(0, n, BLOCK):
        hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])], dtype="<u8")
        set_ += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(sum(1 << i for i in np.flatnonzero(2 * set_ > total).tolist()))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, digest=None) -> DataFrame:
    """(doc_id, fp), fp as a signed long; one row per row of docs. A digest
    expression becomes a third column."""
    extra = [] if digest is None else ["digest"]

    def run(batches):
        for batch in batches:
            found = [_signed(fingerprint(t.as_py(), shingle)) for t in batch.column("text")]
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(found, pa.int64()), *map(batch.column, extra)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", *extra])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *([] if digest is None else [digest.alias("digest")]))
    return rows.mapInArrow(run, "doc_id long, fp long" + ", digest binary" * len(extra))


def spanning_links(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links within the radius that connect what all such links connect."""
    links, left = [], fps
    while left.size:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                hit = left[near]
                left = left[~near]
                links += [(int(x), int(y)) for y in hit]
                queue += list(hit)
    return links


def _bucket_links(wide: int | None, radius: int):
    """Reads rows (tab, key, fp) in order; gives links, or the rows of buckets
    over wide again, marked by their table."""

    def run(batches):
        held = np.empty((0, 3), np.int64)
        passing = None  # the wide bucket whose rows are being passed on
        out_u, out_v, out_t = [], [], []

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(out_t, pa.int32()), pa.array(out_u, pa.int64()), pa.array(out_v, pa.int64())], ["tab", "u", "v"])
            out_t.clear(), out_u.clear(), out_v.clear()
            return batch

        def close(rows):
            nonlocal passing
            if wide is not None and len(rows) > wide:
                passing = (rows[0, 0], rows[0, 1])
                out_t.extend(rows[:, 0].tolist()), out_u.extend(rows[:, 2].tolist()), out_v.extend([None] * len(rows))
                return
            for u, v in spanning_links(np.unique(rows[:, 2]).view(np.uint64), radius):
                out_t.append(-1), out_u.append(_signed(u)), out_v.append(_signed(v))

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            if passing is not None:
                same = (rows[:, 0] == passing[0]) & (rows[:, 1] == passing[1])
                stop = len(rows) if same.all() else int(np.argmin(same))
                out_t.extend(rows[:stop, 0].tolist()), out_u.extend(rows[:stop, 2].tolist()), out_v.extend([None] * stop)
                rows = rows[stop:]
                if len(rows):
                    passing = None
            rows = np.concatenate([held, rows])
            if len(rows):
                cuts = np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])) + 1
                edges = np.concatenate([[0], cuts, [len(rows)]])
                size = np.diff(edges)
                for i in np.flatnonzero(size[:-1] > 1):
                    close(rows[edges[i] : edges[i + 1]])
                passing = None
                held = rows[edges[-2] :]
                if wide is not None and len(held) > wide:
                    close(held)
                    held = held[:0]
            if out_t:
                yield flush()
        if len(held) > 1:
            close(held)
        if out_t:
            yield flush()

    return run


def links(fps: DataFrame, radius: int = RADIUS, wide: int = WIDE) -> DataFrame:
    """Links (u, v) between distinct fingerprints (fp) that connect exactly
    what all pairs within the radius connect. radius is at most 3."""
    if radius > RADIUS:
        raise ValueError("the masks cover a radius of at most 3")
    rows = "tab int, u long, v long"

    def dealt(df, tables):
        keyed = df.select(F.explode(tables).alias("t"), "fp").select("t.tab", "t.key", "fp")
        return keyed.repartition("tab", "key").sortWithinPartitions("tab", "key", "fp")

    first = F.array(*[F.struct(F.lit(i).alias("tab"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(MASKS)])
    found, _ = store(dealt(fps, first).mapInArrow(_bucket_links(wide, radius), rows), "buckets")
    finer = F.array(*[F.array(*[F.lit(_signed(m)) for m in t]) for t in FINER])
    second = F.transform(
        F.element_at(finer, F.col("tab") + 1),
        lambda m, i: F.struct((F.col("tab") * 16 + i).alias("tab"), F.col("fp").bitwiseAND(m).alias("key")),
    )
    again = dealt(found.where("v IS NULL").select("tab", F.col("u").alias("fp")), second).mapInArrow(_bucket_links(None, radius), rows)
    return found.where("v IS NOT NULL").unionByName(again).select("u", "v")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, wide: int = WIDE) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id.

    A null or wordless text has fingerprint zero and links like any other;
    fewer words than a shingle are one shingle. component_id is the smallest
    doc_id reachable over links of at most radius bits, null only where no
    document of the component has a doc_id. Rows that repeat a doc_id each get a
    row. Empty input gives no rows; further columns are ignored.
    """
    prints, _ = store(fingerprints(docs, shingle), "fingerprints")
    fps, _ = store(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    with scope(docs.sparkSession):
        labels, _ = store(components(links(fps.select("fp"), radius, wide)), "labels", kept=True)
    named = fps.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_print = named.join(least, "label").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def text_digest():
    return F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))


def keep_one(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """One of docs for each label of rows (doc_id, digest, label), with all columns:
    that with the smallest doc_id, null last, then the smallest text_digest()."""
    keys = [F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id")]
    kept = rows.groupBy("label").agg(F.min(F.struct(*keys, "digest")).alias("least")).select("least.*")
    keyed = docs.select(F.struct("*").alias("doc"), *keys, text_digest().alias("digest"))
    # rows that repeat doc_id and text have one label
    return keyed.join(kept, ["no_id", "id", "digest"], "left_semi").dropDuplicates(["no_id", "id", "digest"]).select("doc.*")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, wide: int = WIDE) -> DataFrame:
    """One document of each component, with all columns: the one with the
    smallest doc_id, null last, then the smallest digest of its text."""
    prints, _ = store(fingerprints(docs, shingle, text_digest()), "fingerprints")
    with scope(docs.sparkSession):
        labels, _ = store(components(links(prints.select("fp").distinct(), radius, wide)), "labels", kept=True)
    rows = prints.join(labels, F.col("fp") == F.col("node"), "left")
    return keep_one(docs, rows.select("doc_id", "digest", F.coalesce("component", "fp").alias("label")))
