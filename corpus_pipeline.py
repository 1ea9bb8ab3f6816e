"""A training-data pipeline over documents, one operator to a stage.

Each stage takes (spark, docs, sf_dir), where docs is all that the stage before
it kept, written as Parquet and read again. All but the last return the columns
of documents. Stages that work on texts in Python get them in small batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loam.llm import bpe, exact, mixing, near, toxicity
from loam.llm.queries import read, word_vocabulary
from loam.llm.shared import drop, scope, small_batches, store


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below 0.5."""
    small_batches(spark)
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id."""
    return exact.without_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of their five-word
    shingles, the one with the smallest doc_id."""
    small_batches(spark)
    return near.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    small_batches(spark)
    return bpe.encoded_digests(docs, word_vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: A trained model, XXH64 fingerprints and a BPE vocabulary have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage stored on its way goes when its
    result is written, and that when the next one's is."""
    docs, before = read(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with scope(spark):
            docs, path = store(stage(spark, docs, sf_dir), f"stage{i}", kept=True)
        if before is not None:
            drop(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
