"""Alignment of two tokenizers over the same texts.

Two tokenizers cut one byte string at different places. Offsets where a token of
each ends cut both token rows into groups, and link the two tokens that end there.
The two sorted rows of ends are merged by merge-path partitioning: a binary search
along each diagonal of the merge grid finds where a piece of equal work begins, so
pieces merge independently of each other and of how long single texts are; each
emits the ends that both rows have, and what a piece leaves open is stitched to
the one before.

A is a byte-level BPE vocabulary in the JSON form of the tokenizers library, B a
model file of the sentencepiece library; their contents, of fixed size, are sent to
the tasks.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _groups, byte_symbols
from .shared import store

#: Tokens of both rows in one piece, and characters of texts that are aligned together.
WORK, TOGETHER = 1 << 15, 1 << 19
#: Pairs whose counts are sent to the tasks; rarer ones are joined by shuffle.
HEAD = 1 << 18
#: Characters that are in the same classes in all Unicode versions of the last ten
#: years; texts of these alone may be encoded by ranks.
SETTLED = regex.compile("[\x00-ɏ‐-‧‰-⁞]*")
#: Longer runs of white space go to the vocabulary's own library.
_LONG_SPACE = regex.compile(r"\s{2000}")


# -- merging


def diagonals(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """How many of a and of b, sorted, lie before each piece of work numbers of
    both, and the whole lengths at the end. Of equal numbers that of a comes
    first; a pair of them is never parted."""
    d = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        more = np.zeros(len(d), bool)
        more[open_] = a[middle[open_]] <= b[d[open_] - middle[open_] - 1]
        low, high = np.where(more, middle + 1, low), np.where(open_ & ~more, middle, high)
    i, j = low, d - low
    at = np.flatnonzero((i > 0) & (j < len(b)))
    j[at] += a[i[at] - 1] == b[j[at]]
    return i, j


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b, sorted and without repeats, of the numbers in both."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(a, b)
    both = np.flatnonzero(a[np.minimum(at, len(a) - 1)] == b)
    return at[both], both


def merged(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """overlaps(a, b), piece by piece. A group of tokens reaches from the overlap
    before it, in whatever piece that lies, to its own."""
    i, j = diagonals(a, b, work)
    found = [(at + i[k], bt + j[k]) for k in range(len(i) - 1) for at, bt in [overlaps(a[i[k] : i[k + 1]], b[j[k] : j[k + 1]])]]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


# -- tokens


class Pair:
    """Two tokenizers with the bytes of their tokens.

    ranks is the vocabulary of A as base64 tokens with ranks, as tiktoken takes it,
    and pattern its splitting pattern; if given, texts of settled characters are
    encoded by it, which is faster and gives the same ids.
    """

    def __init__(self, a: str, b: bytes, ranks: str | None = None, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.quick = Tokenizer.from_str(a), None
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        if ranks is not None:
            import base64

            import tiktoken

            merges = {base64.b64decode(t): int(r) for t, r in map(str.split, ranks.splitlines())}
            self.quick = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        back = {s: i for i, s in enumerate(byte_symbols())}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes([back[s] for s in token]) if all(s in back for s in token) else token.encode()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        if len(self.a_bytes) > 1 << 16 or len(self.b_bytes) > 1 << 16:
            raise ValueError("a vocabulary of more than 65,536 tokens")
        # each id in decimal with what may follow it
        self.a_text = np.array([[f"{i}{e}" for e in ",|"] for i in range(len(self.a_bytes))], object)
        self.b_text = np.array([[f"{i}{e}" for e in ",;"] for i in range(len(self.b_bytes))], object)

    def encode(self, texts: list[str]) -> tuple[list, list]:
        """Ids of A of a space and each text, and of B of each text."""
        spaced = [" " + t for t in texts]
        quick = [self.quick is not None and SETTLED.fullmatch(t) is not None and _LONG_SPACE.search(t) is None for t in spaced]
        slow = iter(self.a.encode_batch_fast([t for t, q in zip(spaced, quick) if not q], add_special_tokens=False))
        a = [self.quick.encode_ordinary(t) if q else next(slow).ids for t, q in zip(spaced, quick)]
        return a, self.b.encode(texts, num_threads=1)

    def align(self, texts: list[str | None]) -> pa.RecordBatch:
        """n_a, n_b, n_groups, n_links, groups_sha256 and pairs of each text: the
        pairs of linked ids, a << 16 | b, with how often it links them."""
        some = [(k, t) for k, t in enumerate(texts) if t]
        a, b = self.encode([t for _, t in some])
        good = [
            n for n, (_, t) in enumerate(some)
            if b"".join(map(self.a_bytes.__getitem__, a[n])) == (raw := (" " + t).encode()) and b"".join(map(self.b_bytes.__getitem__, b[n])) == raw]
        row = np.array([some[n][0] for n in good], np.int64)
        # rows of texts follow each other; as both cover the same bytes, so do their ends
        a_ids, b_ids = (np.concatenate([np.array(x[n], np.int64) for n in good]) if good else np.zeros(0, np.int64) for x in (a, b))
        a_at, b_at = (np.concatenate([[0], np.cumsum([len(x[n]) for n in good])]).astype(np.int64) for x in (a, b))
        i, j = merged(np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids]))
        at = np.searchsorted(i, a_at)  # the first group of each text

        # group g has the tokens of A up to i[g], then those of B up to j[g]
        last = np.zeros(len(a_ids), np.int64)
        last[i] = 1
        group = np.cumsum(last) - last
        out = np.empty(len(a_ids) + len(b_ids), object)
        out[np.arange(len(a_ids)) + np.concatenate([[0], j + 1])[group]] = self.a_text[a_ids, last]
        last = np.zeros(len(b_ids), np.int64)
        last[j] = 1
        group = np.cumsum(last) - last
        out[np.arange(len(b_ids)) + (i + 1)[group]] = self.b_text[b_ids, last]
        out, ends = out.tolist(), (a_at + b_at).tolist()
        said = [hashlib.sha256("".join(out[ends[n] : ends[n + 1]])[:-1].encode()).hexdigest() for n in range(len(good))]

        links = a_ids[i] << 16 | b_ids[j]
        keys, times = np.unique(np.repeat(np.arange(len(good)), np.diff(at)) << 32 | links, return_counts=True)
        counts = np.zeros((4, len(texts)), np.int64)
        counts[:, row] = np.diff(a_at), np.diff(b_at), np.diff(at), np.diff(at)
        digests = np.full(len(texts), "", object)
        digests[row] = np.array(said, object) if said else ""
        offsets = np.zeros(len(texts) + 1, np.int32)
        offsets[row + 1] = np.bincount(keys >> 32, minlength=len(good))
        pairs = pa.StructArray.from_arrays([pa.array(keys & 0xFFFFFFFF), pa.array(times.astype(np.int32))], ["pair", "n"])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), pairs)
        return pa.RecordBatch.from_arrays([*map(pa.array, counts), pa.array(digests, pa.string()), lists], ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])


def _read(path: str, mode: str = "r"):
    with open(path, mode, encoding=None if "b" in mode else "utf-8") as f:
        return f.read()


def aligned(docs: DataFrame, a_path: str, b_path: str, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs of each row of docs.

    Without tokens, all numbers are 0, the digest is empty and there are no pairs:
    so are texts that are null, empty, or that a tokenizer doesn't give back byte by
    byte. Whole texts are encoded; repeated rows each get a row.
    """
    files = docs.sparkSession.sparkContext.broadcast((_read(a_path), _read(b_path, "rb"), _read(ranks_path) if ranks_path else None, pattern))

    def run(batches):
        pair = Pair(*files.value)
        for batch in batches:
            at = 0
            for texts in _groups(batch.column("text"), TOGETHER):
                part = pair.align(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), *part.columns], ["doc_id", *part.schema.names])
                at += len(texts)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<pair:long,n:int>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, count and best of every pair of rows (pairs): how many links hold it,
    and whether no other pair of its B id has more. The highest counts are broadcast,
    65,536 at most, as an id of B has 16 bits."""
    pairs = rows.select(F.explode("pairs").alias("p")).groupBy("p.pair").agg(F.sum("p.n").alias("count"))
    pairs, _ = store(pairs, "counts")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFF)).alias("b")
    highest = pairs.groupBy(b).agg(F.max("count").alias("highest"))
    joined = pairs.select("*", b).join(F.broadcast(highest), "b")
    return joined.select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def scored(rows: DataFrame, counts: DataFrame, head: int = HEAD) -> DataFrame:
    """rows (row, .., pairs), row being unique, without pairs but with n_best and
    count_sum, both over links, by counts of pair_counts().

    The most frequent pairs, head at most, are sent to the tasks, so that no join
    meets a hot pair; the links of rarer ones are joined by shuffle.
    """
    spark = rows.sparkSession
    level = F.floor(F.log2(F.col("count").cast("double")) + 1e-9).cast("int").alias("level")
    sizes = {r.level: r.n for r in counts.groupBy(level).agg(F.count(F.lit(1)).alias("n")).collect()}  # 63 rows at most
    least, total = max(sizes, default=0) + 1, 0
    while least > 0 and total + sizes.get(least - 1, 0) <= head:
        least -= 1
        total += sizes.get(least, 0)
    frequent = F.col("count") >= F.lit(1 << least)
    table = counts.where(frequent).toArrow()
    order = np.argsort(table.column("pair").to_numpy())
    known = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy()[order] for c in ("pair", "count", "best")))

    kept = [f for f in rows.schema if f.name != "pairs"]
    names = [f.name for f in kept]

    def run(batches):
        keys, count, best = known.value
        for batch in batches:
            lists = batch.column("pairs")
            flat = lists.flatten()
            pair, n = (flat.field(k).to_numpy() for k in (0, 1))
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(keys, pair), max(0, len(keys) - 1))
            there = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], owner[there], np.where(best[at[there]], n[there], 0))
            np.add.at(sums[1], owner[there], n[there] * count[at[there]])
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner[~there], minlength=batch.num_rows))]).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(ends), flat.filter(pa.array(~there)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *map(pa.array, sums), rest], [*names, "n_best", "count_sum", "rest"])

    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*kept, StructField("n_best", LongType()), StructField("count_sum", LongType()), StructField("rest", rows.schema["pairs"].dataType)])
    found = rows.mapInArrow(run, schema)
    if least == 0:
        return found.drop("rest")
    found, _ = store(found, "scored")
    rest = found.select("row", F.explode("rest").alias("p")).select("row", "p.pair", "p.n").join(counts.where(~frequent), "pair")
    sums = rest.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("_best"), F.sum(F.col("n") * F.col("count")).alias("_sum"))
    joined = found.drop("rest").join(sums, "row", "left")
    return joined.withColumns({"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))}).drop("_best", "_sum")


def alignment(docs: DataFrame, a_path: str, b_path: str, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each
    row of docs (doc_id, text); see aligned(), pair_counts() and scored().

    Texts are encoded once; links are kept as each document's pairs with their
    numbers, in the shared folder. No rows give none; further columns are ignored.
    """
    rows, _ = store(aligned(docs, a_path, b_path, ranks_path, pattern).select(F.monotonically_increasing_id().alias("row"), "*"), "aligned")
    counts, _ = store(pair_counts(rows), "pairs")
    return scored(rows, counts).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
