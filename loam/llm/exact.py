"""Exact deduplication through a log-structured merge index of text digests.

Documents are flushed in batches. A flush aggregates its batch in memory (the
partial aggregates are the memtables) and writes one run of the index, sorted by
digest, with a filter: a bitmap of fixed size in which each digest sets a bit. The
digests of a flush are looked up in the older runs, but only those that a run's
filter lets through. Full levels are compacted into the next, and the smallest
identifier of a digest is kept. Digests that a flush holds twice or finds in an
older run are hits; their texts, and no others, are compared byte by byte.

DataFrame operations only.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACE, drop, quoted, scope, scratch, store

#: Batches that one call flushes.
FLUSHES = 3
#: Runs of a level that are compacted into one of the next.
FANOUT = 3
#: Bits of a filter: 8 MB at most, whatever the number of digests, so it may be
#: broadcast. A fuller filter lets more through, and loses nothing.
FILTER_BITS = 1 << 26
#: Bits of one row of a filter, set by Spark's bitmap functions.
ROW_BITS = 32768


def normalised(text):
    """Null as empty; each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _null_last(doc_id):
    """A number that orders doc_ids, null last."""
    return F.coalesce(doc_id.cast("decimal(20,0)"), F.lit(str(2**63)).cast("decimal(20,0)"))


def _merged(entries: DataFrame) -> DataFrame:
    """One entry for each digest: its smallest doc_id, a row that has it, and the
    number of rows."""
    keep_row = F.min_by("keep_row", _null_last(F.col("keep_id"))).alias("keep_row")
    return entries.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), keep_row, F.sum("rows").alias("rows"))


def filter_of(digests: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """(bucket, bitmap) of the digests; bits / ROW_BITS rows at most."""
    place = F.pmod(F.xxhash64("digest"), F.lit(bits)) + 1
    placed = digests.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    return placed.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def maybe_in(rows: DataFrame, bitmaps: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose digest may be among those that the filter was made of."""
    place = F.pmod(F.xxhash64("digest"), F.lit(bits)) + 1
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("bitmap", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte.cast("long"), bit.bitwiseAND(F.lit(7)).cast("int")) == 1
    return rows.join(F.broadcast(bitmaps), (F.bitmap_bucket_number(place) == F.col("bucket")) & is_set, "left_semi")


class DigestIndex:
    """Runs of (digest, keep_id, keep_row, rows), each sorted by digest and with a
    filter, in levels."""

    SCHEMA = "digest binary, keep_id long, keep_row long, rows long"

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, bits: int = FILTER_BITS):
        self.spark, self.fanout, self.bits = spark, fanout, bits
        self.levels: list[list[str]] = []
        self.filtered: set[str] = set()
        self.root = scratch(spark, "digests")

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def _read(self, run: str) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(f"{run}/entries")

    def _filter(self, run: str) -> DataFrame:
        """A run's filter, written when it is first asked for."""
        if run not in self.filtered:
            filter_of(self._read(run), self.bits).write.parquet(f"{run}/filter")
            self.filtered.add(run)
        return self.spark.read.schema("bucket long, bitmap binary").parquet(f"{run}/filter")

    def _write(self, entries: DataFrame) -> str:
        run = f"{self.root}/{uuid.uuid4().hex}"
        entries.sortWithinPartitions("digest").write.parquet(f"{run}/entries")
        return run

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The entries of all runs for keys (digest), by way of their filters."""
        found = [maybe_in(keys, self._filter(run), self.bits).join(self._read(run), "digest") for run in self.runs()]
        return reduce(DataFrame.unionByName, found) if found else keys.join(self.spark.createDataFrame([], self.SCHEMA), "digest")

    def flush(self, keyed: DataFrame) -> DataFrame:
        """Add documents (digest, doc_id, row) as a run; gives the hits (digest),
        stored: digests that the batch repeats or an older run has."""
        memtable = keyed.select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("rows"))
        run = self._write(_merged(memtable))
        own = self._read(run)
        hits, _ = store(own.where("rows > 1").select("digest").unionByName(self.lookup(own.select("digest")).select("digest")), "hits")
        self._add(run, 0)
        return hits

    def _add(self, run: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._add(self._compacted(old), level + 1)

    def _compacted(self, runs: list[str]) -> str:
        merged = self._write(_merged(reduce(DataFrame.unionByName, map(self._read, runs))))
        for run in runs:
            drop(self.spark, run)
        return merged

    def compact(self) -> DataFrame:
        """Merge all runs into one, which has each digest once, and return it."""
        runs = self.runs()
        if len(runs) != 1:
            runs = [self._compacted(runs)] if runs else [self._write(self.spark.createDataFrame([], self.SCHEMA))]
            self.levels = [[], runs]
        return self._read(runs[0])


def exact_duplicates(docs: DataFrame, flushes: int = FLUSHES, fanout: int = FANOUT, bits: int = FILTER_BITS, key=None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of space, tab, newline,
    vertical tab, form feed or carriage return is one space; a null text is an
    empty one. The row with the smallest doc_id of equal texts stays; a row
    without doc_id stays only where its group has none. Of rows that repeat a
    doc_id and a text, one stays. Empty input gives no rows; further columns
    are ignored. key makes the index's key of a SHA-256 digest, which it is by
    default; texts that share a key are still told apart by their bytes.
    """
    spark = docs.sparkSession
    key = key or (lambda digest: digest)
    norm = docs.select("doc_id", normalised(F.col("text")).alias("norm")).withColumn("sha", F.unhex(F.sha2("norm", 256)))
    norm = norm.withColumn("digest", key(F.col("sha")))
    keyed, _ = store(norm.select(F.monotonically_increasing_id().alias("row"), "doc_id", "sha", "digest"), "keyed")
    index = DigestIndex(spark, fanout, bits)
    batch = F.pmod(F.xxhash64("row"), F.lit(flushes))
    with scope(spark):
        hits = [index.flush(keyed.where(batch == i)) for i in range(flushes)]
        entries = index.compact()
        clash = _clashes(norm, reduce(DataFrame.unionByName, hits), bits)
    if clash.isEmpty():
        rows = keyed.join(entries, "digest")
    else:  # digests that stand for different bytes: their groups come from the bytes
        sure = keyed.join(clash, "digest", "left_anti").join(entries, "digest")
        real, _ = store(norm.join(clash, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()), "real")
        by_text = real.groupBy("digest", "norm").agg(
            F.min("doc_id").alias("keep_id"), F.min_by("row", _null_last(F.col("doc_id"))).alias("keep_row"), F.count(F.lit(1)).alias("rows"))
        rows = sure.unionByName(real.join(by_text, ["digest", "norm"]).select(sure.columns))
    return rows.select("doc_id", "keep_id", F.col("rows").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def _clashes(norm: DataFrame, hits: DataFrame, bits: int) -> DataFrame:
    """Byte verification of the hits: the digests that stand for several texts.

    Equal texts meet before the shuffle, so a text that a third of the rows hold is
    sent once by each task. A text that the filter lets through by chance is alone.
    """
    hit_bits, _ = store(filter_of(hits, bits), "hitbits")
    texts = maybe_in(norm.select("digest", "norm"), hit_bits, bits).groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("rows"))
    return store(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "clash", kept=True)[0]


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that exact_duplicates() keeps, with all their columns.

    Rows that repeat both doc_id and text are kept once: the one whose raw text, then
    whose other columns, have the smallest digest or JSON, so reruns agree.
    """
    keys = lambda digest: [_null_last(F.col("doc_id")).alias("id"), digest.alias("digest")]
    kept = exact_duplicates(docs).where("kept").select(*keys(F.unhex("text_sha256")))
    others = [F.to_json(F.struct(*[docs[quoted(c)] for c in docs.columns if c not in ("doc_id", "text")]))] if len(docs.columns) > 2 else []
    order = F.struct(F.md5(F.col("text").cast("binary")), *others)
    keyed = docs.select(F.struct("*").alias("doc"), *keys(F.unhex(F.sha2(normalised(F.col("text")), 256))), order.alias("order"))
    kept_rows = keyed.join(kept, ["id", "digest"], "left_semi").groupBy("id", "digest").agg(F.min_by("doc", "order").alias("doc"))
    return kept_rows.select("doc.*")


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM n
"""
