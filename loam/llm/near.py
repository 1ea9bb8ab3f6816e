"""Near-duplicates by exact Jaccard similarity of word shingles.

Two kinds of tables propose pairs: the covering tables of SimHash fingerprints,
and bands of minimal hashes, which also propose the pairs whose fingerprints
differ in many bits. Of the pairs with similarity 0.8, one in 2,800 shares none
of the 20 bands of 5; of those with 0.85 one in 36,000. Each proposed pair is
then decided by the shingle sets themselves, so that a link is never a guess.

The rows of a bucket are compared with its most central member first, the one that
meets most others in all its buckets, then with the most central of those that this
leaves in other components: a bucket of copies costs a comparison or two a member.
What is then still apart is searched by a prefix filter with positions (PPJoin, Xiao
et al. 2008), which loses no pair of the similarity: of two similar sets, put in the
order of rarity, the first shared shingle comes early in both. Variants of a text
that each changed other words share nothing early, so they are not paired.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .shared import components, scope, store

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 20, 5
#: Shingles hashed by all functions at once.
BLOCK = 2048
#: Shingles in one Arrow batch of sets, unless a single text has more.
SET_BATCH = 1 << 18

_random = np.random.default_rng(20)
_TIMES = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(simhash._LOWER).split()


def shingle_hashes(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the word shingles in order; fewer words than a shingle are one."""
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    ends, digest = ends[min(shingle, len(words)) - 1 :].tolist(), xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), ends)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """SimHash of shingle hashes; 0 without any."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), simhash.BLOCK):
        bits = np.unpackbits(hashes[at : at + simhash.BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * total > len(hashes)).tolist()))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band of minimal hashes; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        least = np.minimum(least, (hashes[at : at + BLOCK, None] * _TIMES + _PLUS).min(axis=0))
    return [simhash._signed(xxhash.xxh64_intdigest(band.tobytes(), i)) for i, band in enumerate(least.reshape(BANDS, ROWS))]


def sketches(rows: DataFrame, shingle: int = SHINGLE, node_bits: int = 64) -> DataFrame:
    """(doc_id, digest, node, check, fp, n, keys) of rows (doc_id, digest, text): node
    and check, two hashes, name the words of the text, n is the size of its shingle set."""
    bits = (1 << node_bits) - 1

    def run(batches):
        for batch in batches:
            found = []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                hashes = shingle_hashes(words, shingle)
                own = np.unique(hashes)
                line = b" ".join(words)
                node, check = (simhash._signed(xxhash.xxh64_intdigest(line, seed) & mask) for seed, mask in ((7, bits), (11, (1 << 64) - 1)))
                found.append((node, check, simhash._signed(majority(hashes)), len(own), band_keys(own)))
            types = (*[pa.int64()] * 4, pa.list_(pa.int64()))
            columns = [pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 5, types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), *columns], ["doc_id", "digest", "node", "check", "fp", "n", "keys"])

    return rows.mapInArrow(run, "doc_id long, digest binary, node long, check long, fp long, n long, keys array<long>")


def _told_apart(sketch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sketch, with nodes that stand for one text each, and a row for each node.

    Texts are told apart by node and check, 128 bits. Of several that share a node, as
    a few do among billions, all but the one with the smallest check get another,
    until no node is shared.
    """
    first = [F.first(c).alias(c) for c in ("fp", "n", "keys")]
    nodes, _ = store(sketch.groupBy("node", "check").agg(F.min("digest").alias("digest"), *first), "nodes")
    taken = nodes.select("node", "check", F.col("node").alias("name"))
    shared = lambda rows: rows.groupBy("name").agg(F.min("check").alias("least"), F.count(F.lit(1)).alias("texts")).where("texts > 1").select("name", "least")
    clash, turn, renamed = store(shared(taken), "clash")[0], 0, False
    while not clash.isEmpty():
        turn, renamed = turn + 1, True
        other = F.when(F.col("check") > F.col("least"), F.xxhash64(F.lit(turn), "node", "check")).otherwise(F.col("name"))
        taken, _ = store(taken.join(clash, "name", "left").select("node", "check", other.alias("name")), "names")
        clash = store(shared(taken), "clash")[0]
    if not renamed:
        return sketch, nodes
    named = lambda rows: rows.join(taken, ["node", "check"]).drop("node").withColumnRenamed("name", "node")
    return named(sketch), store(named(nodes), "nodes")[0]


def shingle_sets(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, shingles) of rows (node, text)."""

    def run(batches):
        def batch_of(nodes, sets):
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

        for batch in batches:
            nodes, sets, size = [], [], 0
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text")):
                own = np.unique(shingle_hashes(words_of(text.as_py()), shingle)).view(np.int64)
                if nodes and size + len(own) > SET_BATCH:
                    yield batch_of(nodes, sets)
                    nodes, sets, size = [], [], 0
                nodes.append(node), sets.append(own)
                size += len(own)
            yield batch_of(nodes, sets)

    return rows.mapInArrow(run, "node long, shingles array<long>")


def _sized(pairs: DataFrame, similar: float) -> DataFrame:
    """Pairs (u, v) whose set sizes (m, n) allow the similarity, each once."""
    close = F.least("m", "n") >= similar * F.greatest("m", "n") - 1e-9
    return pairs.where(close & (F.col("u") != F.col("v"))).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _similar(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets have at least the similarity."""
    a = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = pairs.join(b, "v").join(a, "u").select("u", "v", (F.size("a") + F.size("b")).alias("sizes"), F.size(F.array_intersect("a", "b")).alias("shared"))
    return both.where(F.col("shared") >= similar * (F.col("sizes") - F.col("shared")) - 1e-9).select("u", "v")


def _stars(members: DataFrame) -> DataFrame:
    """(u, v, m, n): the most central member of each bucket with its others."""
    rank = F.struct((-F.col("weight")).alias("w"), "node", "n")
    centre = members.groupBy("key").agg(F.min(rank).alias("c"))
    return members.join(centre, "key").select(F.col("c.node").alias("u"), F.col("node").alias("v"), F.col("c.n").alias("m"), "n")


def _apart(members: DataFrame, near: DataFrame) -> DataFrame:
    """members with the label of their component, of the buckets that hold several."""
    with scope(members.sparkSession):
        labels, _ = store(components(near), "labels", kept=True)
    named = members.join(labels, "node", "left").select("key", "node", "n", "weight", F.coalesce("component", "node").alias("label"))
    parts = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    return named.join(parts, "key", "left_semi")


def _second_stars(apart: DataFrame) -> DataFrame:
    """(u, v, m, n): of each bucket, the most central member outside the component
    of the most central one, with the members of other components."""
    rank = F.struct((-F.col("weight")).alias("w"), "node", "n", "label")
    first = apart.groupBy("key").agg(F.min(rank).alias("f")).select("key", F.col("f.label").alias("main"))
    second = apart.join(first, "key").where("label <> main").groupBy("key").agg(F.min(rank).alias("c"))
    met = apart.join(second, "key").where(F.col("label") != F.col("c.label"))
    return met.select(F.col("c.node").alias("u"), F.col("node").alias("v"), F.col("c.n").alias("m"), "n")


def prefix_pairs(nodes: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Pairs (u, v) of nodes (node, label, n) of different labels that can have the
    similarity t, by the first shingle they share in the order of rarity.

    Two sets of sizes a <= b share t / (1 + t) * (a + b) shingles at least, so each
    has that many from the first shared one on. A shingle meets only sets of the
    sizes for which its place allows that, in classes of two per cent.
    """
    t = similar
    size_class = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(1.02))).cast("int")
    tokens = nodes.join(sets, "node").select("node", "label", "n", F.explode("shingles").alias("s"))
    rarity = tokens.groupBy("s").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")  # the others meet nobody, but come first
    known = tokens.join(rarity, "s").groupBy("node", "label", "n").agg(F.array_sort(F.collect_list(F.struct("rows", "s"))).alias("own"))
    alone = F.col("n") - F.size("own")  # places of the shingles that no other set has
    early = F.greatest(F.lit(0), F.floor(F.col("n") * (1 - t) + 1e-9).cast("int") + 1 - alone)
    placed = known.where(early > 0).select("node", "label", "n", alone.alias("alone"), F.posexplode(F.slice("own", F.lit(1), early)).alias("i", "o"))
    placed = placed.select("node", "label", "n", F.col("o.s").alias("s"), (F.col("alone") + F.col("i")).alias("at"))
    share = t / (1 + t)
    small = placed.where(F.col("n") - F.col("at") >= 2 * share * F.col("n") - 1e-9)  # the smaller set, against one no smaller
    small = small.select("s", size_class(F.col("n")).alias("c"), F.col("node").alias("u"), F.col("label").alias("lu"), F.col("n").alias("a"), F.col("at").alias("j"))
    most = F.least(F.col("n"), F.floor((F.col("n") - F.col("at")) / share - F.col("n") + 1e-9).cast("int"))
    large = placed.withColumns({"least": F.ceil(t * F.col("n") - 1e-9).cast("int"), "most": most}).where("least <= most")
    classes = F.sequence(size_class(F.col("least")), size_class(F.col("most")))
    large = large.select("s", F.explode(classes).alias("c"), F.col("node").alias("v"), F.col("label").alias("lv"), F.col("n").alias("b"), "least", "most")
    met = small.join(large, ["s", "c"]).where((F.col("lu") != F.col("lv")) & F.col("a").between(F.col("least"), F.col("most")))
    met = met.where(F.col("a") - F.col("j") >= share * (F.col("a") + F.col("b")) - 1e-9)
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def links(nodes: DataFrame, texts: DataFrame, shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """Links (u, v) between nodes (node, digest, fp, n, keys) that connect what
    the similar pairs among the proposed ones connect. texts is (digest, text)."""
    keyed = nodes.select(F.explode("keys").alias("key"), "node", "n")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    met, _ = store(keyed.join(shared, "key"), "met")
    weights = met.groupBy("node").agg(F.sum("rows").alias("weight"))
    members, _ = store(met.drop("rows").join(weights, "node").select("key", "node", "n", "weight"), "members")

    # the same from fingerprints: a star for each, and their links
    prints, _ = store(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("first")), "prints")
    one = nodes.join(prints, "fp").select(F.col("first.node").alias("u"), F.col("node").alias("v"), F.col("first.n").alias("m"), "n")
    u, v = (prints.select(F.col("fp").alias(x), F.col("first").alias(f"first_{x}")) for x in "uv")
    across = simhash.links(prints.select("fp")).join(u, "u").join(v, "v")
    across = across.select(F.col("first_u.node").alias("u"), F.col("first_v.node").alias("v"), F.col("first_u.n").alias("m"), F.col("first_v.n").alias("n"))
    pairs, _ = store(_sized(_stars(members).unionByName(one).unionByName(across), similar), "pairs")

    asked = members.select("node").union(pairs.select("u")).union(pairs.select("v")).distinct()
    digests = nodes.join(asked, "node", "left_semi").select("node", "digest")
    sets, _ = store(shingle_sets(texts.join(digests, "digest").dropDuplicates(["digest"]).select("node", "text"), shingle), "sets")
    near, _ = store(_similar(pairs, sets, similar), "near")

    # buckets that are still in parts
    second, _ = store(_sized(_second_stars(_apart(members, near)), similar), "second")
    near, _ = store(near.unionByName(_similar(second, sets, similar)), "near")
    apart = _apart(members, near).select("node", "label", "n").distinct()
    left, _ = store(apart, "left")
    more, _ = store(prefix_pairs(left, sets, similar), "more")
    return near.unionByName(_similar(more, sets, similar))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, similar: float = SIMILAR, node_bits: int = 64) -> DataFrame:
    """One document of each component of similar ones, with all columns: the one
    with the smallest doc_id, null last, then the smallest digest of its text.

    Documents are similar when their sets of shingles (lower-cased words) have at
    least the Jaccard similarity. Fewer words than a shingle are one shingle;
    null and wordless texts are alike. Nodes of fewer bits only cost time: texts that
    share one are told apart.
    """
    rows = docs.select(F.col("doc_id").cast("long"), simhash.text_digest().alias("digest"), F.col("text").cast("string"))
    sketch, nodes = _told_apart(store(sketches(rows, shingle, node_bits), "sketches")[0])
    with scope(docs.sparkSession):
        labels, _ = store(components(links(nodes, rows.select("digest", "text"), shingle, similar)), "labels", kept=True)
    named = sketch.select("doc_id", "digest", "node").join(labels, "node", "left")
    return simhash.keep_one(docs, named.select("doc_id", "digest", F.coalesce("component", "node").alias("label")))
