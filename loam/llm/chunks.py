"""Repeated substrings by content-defined chunking.

A gear hash rolls over the bytes of a text; a cut follows every byte whose hash
is the least of its neighbourhood, so cuts depend on nearby bytes alone and an
insertion moves no cut beyond its surroundings. Chunks are compared by digest
across documents; neighbouring repeated chunks are joined to spans, and spans
that are long enough are reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import store

#: A cut's hash is the least within this many bytes on either side, ties
#: included; chunks have at least one byte more, and 33 on average.
NEAR = 16
#: Longest chunk.
LONGEST = 256
#: Bytes of a repeated span, at least. Chunks inside a passage of 50 words come
#: to more.
SPAN = 100
BLOCK = 1 << 20


def gear_table() -> np.ndarray:
    """A 64-bit value for each byte, by the SplitMix64 generator from 1 on."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


GEAR = gear_table()


def _rolled(data: np.ndarray) -> np.ndarray:
    """Gear hash of the last 16 bytes at each byte (fewer at the start)."""
    h = GEAR[data]
    for width in (1, 2, 4, 8):
        before = np.zeros_like(h)
        before[width:] = h[:-width] if len(h) > width else h[:0]
        h = h + (before << np.uint64(width))
    return h


def _least_ahead(h: np.ndarray) -> np.ndarray:
    """Minimum of the NEAR values from each place on; nothing counts as most."""
    m = np.concatenate([h, np.full(NEAR, np.iinfo(np.uint64).max, np.uint64)])
    width = 1
    while width < NEAR:
        m = np.minimum(m[: len(m) - width], m[width:])
        width *= 2
    return m[: len(h) + 1]


def cuts(raw: bytes) -> np.ndarray:
    """Ends of the chunks of a text, the last one included."""
    data, found = np.frombuffer(raw, np.uint8), []
    for at in range(0, len(data), BLOCK):
        low, high = max(0, at - 2 * NEAR), min(len(data), at + BLOCK + NEAR)
        h = _rolled(data[low:high])
        ahead = _least_ahead(h)
        left = np.full(len(h), np.iinfo(np.uint64).max, np.uint64)
        left[NEAR:] = ahead[: len(h) - NEAR] if len(h) > NEAR else left[NEAR:]
        if low == 0:  # fewer than NEAR bytes before
            short = min(NEAR, len(h))
            left[1:short] = np.minimum.accumulate(h[: short - 1])
        right = ahead[1 : len(h) + 1]
        place = np.flatnonzero((h <= left) & (h <= right)) + low
        found.append(place[(place >= at) & (place < at + BLOCK)] + 1)
    ends = np.unique(np.append(np.concatenate(found), len(data))) if len(data) else np.zeros(0, np.int64)
    if len(ends) > 1 and np.diff(ends).min() <= NEAR:  # ties, in periodic text: the first of each stretch
        kept, before = [], -NEAR
        for e in ends[:-1].tolist():
            if e - before > NEAR:
                kept.append(e)
                before = e
        ends = np.append(np.array(kept, np.int64), ends[-1])
    wide = np.flatnonzero(np.diff(ends, prepend=0) > LONGEST)
    if len(wide):
        starts = np.concatenate([[0], ends[:-1]])
        more = [np.arange(starts[i] + LONGEST, ends[i], LONGEST) for i in wide]
        ends = np.unique(np.concatenate([ends, *more]))
    return ends


def chunked(docs: DataFrame) -> DataFrame:
    """(doc_id, start, size, high, low) of every chunk; offsets are of UTF-8 bytes,
    high and low the halves of a 128-bit digest, so that even in 10^13 chunks two
    different ones share a digest once in ten trillion runs."""

    def run(batches):
        for batch in batches:
            ids, starts, sizes, digests = [], [], [], []

            def out():
                halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                columns = ((np.concatenate(ids), pa.int64()), (np.concatenate(starts), pa.int32()), (np.concatenate(sizes), pa.int32()), (halves[:, 0], pa.int64()), (halves[:, 1], pa.int64()))
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], ["doc_id", "start", "size", "high", "low"])

            held = 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if not raw:
                    continue
                ends = cuts(raw)
                begins = np.concatenate([[0], ends[:-1]])
                digest = xxhash.xxh3_128_digest
                ids.append(np.full(len(ends), doc_id, np.int64))
                starts.append(begins.astype(np.int32))
                sizes.append((ends - begins).astype(np.int32))
                digests += [digest(raw[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
                held += len(ends)
                if held > 1 << 16:
                    yield out()
                    ids, starts, sizes, digests, held = [], [], [], [], 0
            if held:
                yield out()

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, start int, size int, high long, low long")


def repeated_spans(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, start, stop, n_bytes, first_doc_id, dup_bytes, kept of each span
    of a text, in UTF-8 bytes, whose chunks occur in other documents too.

    first_doc_id is the smallest doc_id that has one of the span's chunks;
    dup_bytes are the bytes that a smaller doc_id has already, and kept says that
    there are none. Documents that share nothing have no row, nor do null or
    empty texts and rows without doc_id. Rows that repeat a doc_id are one
    document. Empty input gives no rows; further columns are ignored.
    """
    chunks = chunked(docs)  # computed twice, which costs less than to write and read as many rows
    firsts = chunks.groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("high", "low", "first")
    firsts, _ = store(firsts, "repeated")  # so that both sides of the join are plain shuffles, which Spark can split
    shared = chunks.join(firsts, ["high", "low"]).select("doc_id", "start", "size", "first")
    shared = shared.repartition("doc_id").groupBy("doc_id", "start", "size").agg(F.min("first").alias("first"))
    order = Window.partitionBy("doc_id").orderBy("start", "size")
    begins = (F.col("start") != F.lag(F.col("start") + F.col("size"), 1, -1).over(order)).cast("int")
    runs = shared.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = runs.groupBy("doc_id", "run").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("stop"), F.sum("size").alias("n_bytes"),
        F.min("first").alias("first_doc_id"), F.sum(F.when(F.col("first") < F.col("doc_id"), F.col("size")).otherwise(0)).alias("dup_bytes"))
    return spans.where(F.col("n_bytes") >= span).drop("run").withColumn("kept", F.col("dup_bytes") == 0)


def without_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """docs with the spans cut out that a smaller doc_id has already.

    A cut that would split a character leaves that character out.
    """
    spans = repeated_spans(docs, span).where(~F.col("kept")).groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def cut(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lists in parts:
            out = []
            for text, found in zip(texts, lists):
                if found is None or text is None:
                    out.append(text)
                    continue
                raw, at, keep = text.encode("utf-8", "surrogatepass"), 0, []
                for s in sorted((x["start"], x["stop"]) for x in found):
                    keep.append(raw[at : s[0]])
                    at = s[1]
                out.append(b"".join([*keep, raw[at:]]).decode("utf-8", "ignore"))
            yield pd.Series(out)

    keyed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("whole"))
    joined = keyed.join(spans, F.col("key") == F.col("id"), "left")
    shorter = F.pandas_udf(cut, "string")("whole", "spans")
    return joined.select(F.col("doc").withField("text", shorter).alias("doc")).select("doc.*")
