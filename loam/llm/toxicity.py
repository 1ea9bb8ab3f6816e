"""Toxicity by subword-bag embeddings under a linear softmax.

A word is the average of the embeddings of its character n-grams, which are
hashed into buckets; a window, one word or two neighbouring ones, is the average
of its words, and a linear softmax scores it. Embeddings and softmax are trained
together in numpy. A document counts as toxic if any of its windows does: its
likelihood in training is the noisy-or over its different windows, its score the
largest window probability, so a long clean text doesn't dilute an insult.
Misspelt words share most of their n-gram vectors with the words that were seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most this many labelled documents of each class are learned from, those
#: with the smallest MD5 of their doc_id, and texts of half of SAMPLE_CHARS for each
#: class: a text that no longer fits is passed over. All further counts cover all rows.
SAMPLE = 2000
SAMPLE_CHARS = 1 << 24
BUCKETS = 1 << 16
DIMENSIONS = 8
NGRAMS = (3, 4, 5, 6)
#: Words of a window.
WIDTHS = (1, 2)
STEPS = 60
#: Weight of the squared parameters.
DECAY = 1e-4
#: Bytes of a very long text that are scored at once.
BLOCK = 1 << 18
#: Different words whose n-grams training holds in one part, and groups that are
#: summed at once: both bound temporaries.
PART, GROUPS = 10_000, 1 << 14

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_grams(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(bucket, word) of every n-gram of a text's words, and the word count.

    Words are runs of ASCII letters and digits and of non-ASCII characters,
    lower-cased; n-grams are of UTF-8 bytes, the ends of a word counting as one.
    """
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8)
    inside = _WORD[raw]
    starts = inside & ~np.concatenate([[False], inside[:-1]])
    word = np.cumsum(starts) - 1
    data = np.where(inside, raw, 32).astype(np.uint64)
    buckets, words = [], []
    for n in NGRAMS:
        size = len(data) - n + 1
        if size <= 0:
            continue
        value = np.zeros(size, np.uint64)
        valid = np.ones(size, bool)
        for i in range(n):
            value = value * np.uint64(0x100000001B3) + data[i : i + size]
            if 0 < i < n - 1:
                valid &= inside[i : i + size]
        value = value[valid] + np.uint64(n)
        value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        buckets.append((value >> np.uint64(40)).astype(np.int64) % BUCKETS)
        words.append(word[1 : 1 + size][valid])
    count = int(starts.sum())
    if not count:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    return np.concatenate(buckets), np.concatenate(words), count


def _blocks(text: str):
    """A text in blocks that end at white space where one can be found."""
    at = 0
    while len(text) - at > BLOCK:
        cut = max(text.rfind(" ", at, at + BLOCK), text.rfind("\n", at, at + BLOCK)) + 1
        cut = cut if cut > at else at + BLOCK
        yield text[at:cut]
        at = cut
    yield text[at:]


@dataclass
class Model:
    """vectors (BUCKETS x DIMENSIONS), softmax (DIMENSIONS x 2) and its bias."""

    vectors: np.ndarray
    softmax: np.ndarray
    bias: float

    def gram_scores(self) -> np.ndarray:
        """What each bucket adds to the toxic logit over the other."""
        return self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0])

    def scorer(self):
        grams, bias, longest = self.gram_scores(), self.bias, max(WIDTHS)

        def score(text: str | None) -> float:
            best, tail = -np.inf, np.zeros(0)
            for block in _blocks(text or ""):
                bucket, word, count = word_grams(block)
                if not count:
                    continue
                sums = np.bincount(word, grams[bucket], count)
                words = np.concatenate([tail, sums / np.maximum(np.bincount(word, minlength=count), 1)])
                total = np.concatenate([[0.0], np.cumsum(words)])
                best = max(best, *(((total[w:] - total[:-w]) / w).max() for w in WIDTHS if w <= len(words)))
                tail = words[len(words) - longest + 1 :]
            logit = bias if best == -np.inf else best + bias
            return float(1 / (1 + np.exp(-np.clip(logit, -500, 500))))

        return score


@dataclass
class _Sums:
    """Sums of values by group: values are taken at places that lie in the order
    of their groups."""

    places: np.ndarray
    starts: np.ndarray
    groups: np.ndarray
    size: int

    @classmethod
    def of(cls, group: np.ndarray, place: np.ndarray, size: int) -> _Sums:
        if len(group) and (np.diff(group) < 0).any():
            order = np.argsort(group, kind="stable").astype(np.int32)
            group, place = group[order], place[order]
        starts = np.flatnonzero(np.diff(group, prepend=-1)).astype(np.int32)
        return cls(place.astype(np.int32, copy=False), starts, group[starts], size)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out, n = np.zeros(self.size), len(self.places)
        for a in range(0, len(self.starts), GROUPS):  # a slice at a time, which bounds the temporaries
            starts = self.starts[a : a + GROUPS]
            end = self.starts[a + GROUPS] if a + GROUPS < len(self.starts) else n
            out[self.groups[a : a + GROUPS]] = np.add.reduceat(values[self.places[starts[0] : end]], starts - starts[0])
        return out


def windows(doc_words: list[np.ndarray], n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different windows of all documents, a row of word numbers each (from 1,
    0 where narrower), and (document, window) of each that a document has."""
    docs, keys = [], []
    for i, words in enumerate(doc_words):
        for w in WIDTHS:
            if w <= len(words):
                key = np.zeros(len(words) - w + 1, np.int64)
                for j in range(w):
                    key = key * (n_words + 1) + words[j : len(words) - w + 1 + j] + 1
                keys.append(np.unique(key))
                docs.append(np.full(len(keys[-1]), i, np.int32))
    keys = np.concatenate(keys)
    found = np.unique(keys)
    window = np.searchsorted(found, keys).astype(np.int32)
    del keys
    columns = []
    for _ in range(max(WIDTHS)):
        columns.append((found % (n_words + 1)).astype(np.int32))
        found = found // (n_words + 1)
    return np.stack(columns[::-1], axis=1), np.concatenate(docs), window


def fit(texts: list[str], labels: list[int], steps: int = STEPS, seed: int = 7) -> Model:
    """Train embeddings and softmax together, full-batch Adam.

    Without an example of both classes the model scores everything 0 or 1, as
    its only class, or 0 if there is none at all.
    """
    y = np.asarray(labels, np.float64)
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    softmax = rng.normal(0, 0.1, (DIMENSIONS, 2))
    # each different word once; documents as the numbers of their words
    known: dict[bytes, int] = {}
    doc_words, blank = [], bytes(c if _WORD[c] else 32 for c in range(256))
    for t in texts:
        raw = (t or "").lower().encode("utf-8", "surrogatepass").translate(blank)
        doc_words.append(np.array([known.setdefault(w, len(known)) for w in raw.split()], np.int64))
    some = np.array([len(d) > 0 for d in doc_words], bool)
    if not some.any() or y[some].min() == y[some].max():
        return Model(np.zeros_like(vectors), np.zeros_like(softmax), 50.0 if len(y) and y.min() > 0 else -50.0)
    y, doc_words = y[some], [d for d in doc_words if len(d)]
    listed, n_words, parts = list(known), len(known), []
    for at in range(0, n_words, PART):
        some_words = listed[at : at + PART]
        bucket, word, _ = word_grams(b" ".join(some_words).decode("utf-8", "surrogatepass"))
        bucket, word = bucket.astype(np.int32), word.astype(np.int32)
        grams_of = np.maximum(np.bincount(word, minlength=len(some_words)), 1)
        parts.append((slice(at, at + len(some_words)), _Sums.of(word, bucket, len(some_words)), _Sums.of(bucket, word, BUCKETS), grams_of))
    del known, listed, bucket, word
    members, doc, window = windows(doc_words, n_words)
    del doc_words
    width = (members > 0).sum(axis=1)
    by_doc, by_window = _Sums.of(doc, window, len(y)), _Sums.of(window, doc, len(members))
    held = members > 0
    of_word = _Sums.of(members[held] - 1, np.nonzero(held)[0], n_words)
    del doc, window, held
    bias, share = -6.0, np.where(y == 1, 0.25 / max(1, (y == 1).sum()), 0.75 / max(1, (y == 0).sum()))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (vectors, softmax, np.zeros(1))]
    for step in range(1, steps + 1):
        weight = softmax[:, 1] - softmax[:, 0]
        grams = vectors @ weight
        scores = np.concatenate([[0.0], *(by_word(grams) / n for _, by_word, _, n in parts)])
        z = sum(scores[c] for c in members.T) / width + bias
        odds = np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))
        total = by_doc(odds)  # a document's -log P(clean), summed over its windows
        # d loss / d total: the clean ones pay total, the toxic ones -log(1 - e^-total)
        slope = np.where(y == 1, -1 / np.expm1(np.clip(total, 1e-9, 50)), 1.0) * share
        dz = by_window(slope) * -np.expm1(-odds)
        dword = of_word(dz / width)
        dgram = sum(by_bucket(dword[at] / n) for at, _, by_bucket, n in parts)
        dweight = vectors.T @ dgram
        grads = (np.outer(dgram, weight) + DECAY * vectors, np.stack([-dweight, dweight], 1) + DECAY * softmax, np.array([dz.sum()]))
        params = [vectors, softmax, np.array([bias])]
        for p, g, s in zip(params, grads, state):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.99 * s[1] + 0.01 * g * g
            p -= 0.05 * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-8)
        bias = float(params[2][0])
    return Model(vectors, softmax, bias)


def held_out():
    """True for the fifth of the documents that training never sees."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(doc_id, text, toxic) of the labelled rows of docs that are learned from, none
    of them held out: sample documents of each class at most, and texts of half of so many
    characters for each class, in the order of the MD5 of doc_id; a text that no longer
    fits is passed over, so a very long one leaves the others. Labels other than 0 and 1,
    null identifiers and identifiers with both labels are left out; of texts that
    repeat an identifier the first by code points is read.
    """
    usable = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out())
    one = usable.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    one = one.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    key = F.md5(F.col("doc_id").cast("string").cast("binary"))
    chosen = None
    for toxic in (0, 1):
        part = one.where(F.col("toxic") == toxic).select("doc_id", "toxic").orderBy(key, "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    # at most 2 * sample rows of two numbers: that bounds the broadcast
    room = chars // 2
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.length("text") <= room)
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").cast("int").alias("toxic"))

    def fitting(lengths: pd.DataFrame) -> pd.DataFrame:
        kept, used = [], 0
        for one in lengths.sort_values(["key", "doc_id"]).itertuples():
            if used + one.n <= room:
                kept.append(one.doc_id)
                used += one.n
        return pd.DataFrame({"doc_id": kept}, dtype="int64")

    # a row of numbers for each chosen document, so one task may add up a class
    lengths = rows.select(F.col("doc_id").cast("long"), "toxic", key.alias("key"), F.length("text").alias("n"))
    kept = lengths.groupBy("toxic").applyInPandas(fitting, "doc_id long")
    return rows.join(F.broadcast(kept), "doc_id", "left_semi").select("doc_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """A model from training_rows(). One task trains it, as their bound allows, and
    sends the parameters; if its executor is lost, Spark runs it again."""

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        model = fit(rows["text"].tolist(), rows["toxic"].tolist())
        return pd.DataFrame({"vectors": [model.vectors.astype("<f4").tobytes()], "softmax": [model.softmax.astype("<f8").tobytes()], "bias": [model.bias]})

    trained = training_rows(docs, labels, sample, chars).groupBy((F.col("toxic") >= 0).alias("all")).applyInPandas(learn, "vectors binary, softmax binary, bias double").first()
    if trained is None:
        return fit([], [])
    vectors, softmax = np.frombuffer(trained.vectors, "<f4"), np.frombuffer(trained.softmax, "<f8")
    return Model(vectors.reshape(BUCKETS, DIMENSIONS), softmax.reshape(DIMENSIONS, 2), trained.bias)


def score_column(docs: DataFrame, model: Model, text: str = "text"):
    """A column expression: the score of a whole text, null as empty."""
    sent = docs.sparkSession.sparkContext.broadcast((model.vectors.astype(np.float32), model.softmax, model.bias))

    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vectors, softmax, bias = sent.value
        one = Model(vectors, softmax, bias).scorer()
        for texts in parts:
            yield pd.Series([one(t) for t in texts], dtype="float64")

    return F.pandas_udf(score, "double")(F.col(text).cast("string"))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    score is the softmax probability of the most toxic window, from the whole
    text alone; a null or wordless text gets the bias alone. Repeated rows are
    scored alike; a null doc_id counts as the empty text for held_out; empty
    tables give no rows, and labels without both classes a constant score.
    """
    model = train(docs, labels, sample)
    scored = docs.select("doc_id", held_out().alias("held_out"), score_column(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that score below 0.5, with all their columns."""
    return docs.where(score_column(docs, train(docs, labels, sample)) < 0.5)
