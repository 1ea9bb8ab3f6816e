"""Byte-pair encoding and decoding by batched merge rounds.

The symbols of many words lie in one flat array. A round looks all neighbouring
pairs up by binary search over the sorted pair keys, takes each word's lowest
rank, merges its occurrences from the left and closes the gaps; words without a
pair left drop out. The vocabulary is a public file in the JSON form of the
tokenizers library; its path is a parameter, and its text, of fixed size, is
sent to the tasks.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose encoding a task keeps; it starts anew when they are as many.
KNOWN = 1 << 16
#: Characters of text whose new words are merged together.
TOGETHER = 1 << 18
_NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies:
    itself where printable, else the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
    return [chr(moved.get(b, b)) for b in range(256)]


class Bpe:
    """A byte-level BPE vocabulary with an end-of-word suffix.

    Supports the forms that the word vocabularies of public models have: NFC,
    white space and lower-case normalisers, one splitting pattern, byte-level
    symbols, special tokens cut out of the raw text, and no decoder, so decoding
    joins the tokens by spaces.
    """

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        splitters = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None or [s["type"] for s in splitters] != ["Split", "ByteLevel"]:
            raise ValueError("a vocabulary of another form")
        self.size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * self.size
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        symbols = byte_symbols()
        self.inner = np.array([self.vocab[s] for s in symbols], np.int64)
        self.final = np.array([self.vocab[s + suffix] for s in symbols], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([self.vocab[a] * self.size + self.vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        self.words = regex.compile(splitters[0]["pattern"]["Regex"])
        self.spaces = regex.compile(spec["normalizer"]["normalizers"][1]["pattern"]["Regex"])
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[str, bytes] = {}

    def normalise(self, text: str) -> str:
        text = self.spaces.sub(" ", unicodedata.normalize("NFC", text))
        return text.replace("Σ", "σ").lower()

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens of a whole text, in order."""
        if self.cut is None or self.cut.search(text) is None:
            return self.words.findall(self.normalise(text))
        out, at = [], 0
        for hit in self.cut.finditer(text):
            out += self.words.findall(self.normalise(text[at : hit.start()]))
            out.append(hit.group())
            at = hit.end()
        return out + self.words.findall(self.normalise(text[at:]))

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and where each word's begin, and the end."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(sizes)
        sym = self.inner[flat]
        sym[ends - 1] = self.final[flat[ends - 1]]
        owner = np.repeat(np.arange(len(raw)), sizes)
        ended: list = []

        while len(sym):
            key = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (owner[1:] == owner[:-1]), self.ranks[at], _NONE)
            rank = np.append(rank, _NONE)
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.minimum.reduceat(rank, starts)
            count = np.diff(np.append(starts, len(sym)))
            low = np.repeat(least, count)
            over = low == _NONE
            if over.any():
                ended.append((sym[over], owner[over]))
                sym, owner, rank, low = sym[~over], owner[~over], rank[~over], low[~over]
                if not len(sym):
                    break
            hit = rank == low
            # of overlapping occurrences, every other one from the left
            spot = np.flatnonzero(hit)
            run = np.concatenate([[0], np.cumsum(np.diff(spot) > 1)])
            first = spot[np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])][run]
            spot = spot[(spot - first) % 2 == 0]
            sym[spot] = self.made[rank[spot]]
            keep = np.ones(len(sym), bool)
            keep[spot + 1] = False
            sym, owner = sym[keep], owner[keep]
        owner = np.concatenate([o for _, o in ended])
        ids = np.concatenate([s for s, _ in ended])[np.argsort(owner, kind="stable")]
        return ids.astype("<u4"), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(raw)))])

    def learn(self, words) -> None:
        """Encode those of these words that are not known yet."""
        words = set(words)
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KNOWN:
            self.known = {}
            new = list(words)
        plain = [w for w in new if w not in self.special]
        if plain:
            ids, at = self.merge(plain)
            raw, at = ids.tobytes(), (4 * at).tolist()
            for w, a, b in zip(plain, at, at[1:]):
                self.known[w] = raw[a:b]
        for w in new:
            if w in self.special:
                self.known[w] = np.array([self.special[w]], "<u4").tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        words = self.pieces(text or "")
        self.learn(words)
        return np.frombuffer(b"".join([self.known[w] for w in words]), "<u4")

    def decode(self, ids) -> str:
        return " ".join([self.tokens[i] for i in ids])

    def digests(self, texts) -> list[tuple[int, str, str]]:
        """For each text the number of ids and the SHA-256 of the ids and of
        the decoded text. The new words of all texts are merged together."""
        parts = [self.pieces(t or "") for t in texts]
        self.learn(w for words in parts for w in words)
        known, rows = self.known, []
        for words in parts:
            ids = b"".join([known[w] for w in words])
            text = self.decode(np.frombuffer(ids, "<u4").tolist())
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()))
        return rows


def _groups(column, most: int = TOGETHER):
    """The texts of an Arrow column in groups of about most characters."""
    group, size = [], 0
    for t in column:
        t = t.as_py()
        group.append(t)
        size += len(t or "")
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def _text_of(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs with a column ids, the token ids of its whole text.

    A null or empty text has no ids; special tokens written in a text are
    recognised, as the tokenizers library does. Other columns stay.
    """
    spec = docs.sparkSession.sparkContext.broadcast(_text_of(path))

    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = Bpe(spec.value)
        for texts in parts:
            yield pd.Series([bpe.encode(t).astype(np.int32) for t in texts])

    return docs.withColumn("ids", F.pandas_udf(ids, "array<int>")(F.col("text").cast("string")))


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers,
    decoded_sha256 over the decoded text in UTF-8. A null text is an empty one.
    Repeated rows each get a row; empty input gives none; further columns are
    ignored.
    """
    spec = docs.sparkSession.sparkContext.broadcast(_text_of(path))

    def run(batches):
        bpe = Bpe(spec.value)
        for batch in batches:
            rows = [r for group in _groups(batch.column("text")) for r in bpe.digests(group)]
            n, ids, text = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    one = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return one.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
