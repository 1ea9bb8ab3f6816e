"""Two tokenizers aligned over the same texts, against the libraries one token at a time."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loam.llm import alignment
from loam.llm.queries import queries

SMALL = "/root/testdata/sf0.001"
FILES = [public.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")]
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def brute(docs, libraries):
    a, b = libraries
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    counts, rows = collections.Counter(), []
    for doc, text in docs:
        raw = (" " + (text or "")).encode()
        ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)] if text else [[], []]
        tokens = [
            [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids[0]],
            [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]]
        if not text or any(b"".join(t) != raw for t in tokens):
            rows.append((doc, 0, 0, [], ""))
            continue
        ends = [np.cumsum([len(t) for t in side]).tolist() for side in tokens]
        both = set(ends[0]) & set(ends[1])
        sides = [[[]], [[]]]
        for s in (0, 1):
            for i, e in zip(ids[s], ends[s]):
                sides[s][-1].append(i)
                if e in both:
                    sides[s].append([])
            sides[s].pop()
        links = [(x[-1], y[-1]) for x, y in zip(*sides)]
        counts.update(links)
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in zip(*sides))
        rows.append((doc, *map(len, ids), links, hashlib.sha256(said.encode()).hexdigest()))
    best = collections.Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    done = [(d, n, m, len(k), len(k), sum(counts[x] == best[x[1]] for x in k), sum(counts[x] for x in k), s) for d, n, m, k, s in rows]
    return sorted(done, key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def odd_texts():
    rnd = random.Random(5)
    alphabet = "abc  \n\t.,'sé漢字🙂▁ <s></s>́ß"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 300))) for _ in range(60)]
    return [
        *texts, "", None, " ", "   ", "\n", "a", " a", "<|endoftext|>", "<s>[INST]</s>", "a▁b", "▁", "x" * 5000, "ab " * 20000, " " * 5000 + "a", "word\u0000word",
        "don't we'll I'M", "\U0010ffff", "é ﬁ ２", "<0x41>"]


def test_as_brute_force(spark, documents, libraries):
    docs = [(i, t) for i, t in enumerate(odd_texts())] + [(3, "again"), (3, "again"), (None, "no id")]
    frame = documents(docs).repartition(3)
    want = brute(docs, libraries)
    assert collected(alignment.alignment(frame, *FILES, public.PATTERN)) == want
    assert collected(alignment.alignment(frame, *FILES[:2])) == want
    assert collected(alignment.alignment(documents([]), *FILES, public.PATTERN)) == []
    assert {r[1] for r in collected(alignment.alignment(documents([(1, None), (2, "")]), *FILES, public.PATTERN))} == {0}


def test_whole_table_and_rare_pairs_by_join(spark, libraries):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], libraries)
    assert collected(queries()["op12_token_alignment"](spark, SMALL)) == want
    rows, _ = alignment.store(alignment.aligned(docs, *FILES, public.PATTERN).select(F.monotonically_increasing_id().alias("row"), "*"), "aligned")
    counts, _ = alignment.store(alignment.pair_counts(rows), "pairs")
    for head in (0, 100):
        assert collected(alignment.scored(rows, counts, head)) == want


def test_pieces_are_of_equal_work_and_lose_no_overlap():
    rng = np.random.default_rng(2)
    for n, m, most in ((0, 0, 5), (0, 9, 20), (50, 60, 70), (1000, 10, 2000), (500, 500, 1000), (300, 300, 310)):
        a, b = (np.sort(rng.choice(most, k, replace=False)) for k in (n, m))
        both = np.intersect1d(a, b)
        for work in (1, 2, 7, 64, 5000):
            i, j = alignment.diagonals(a, b, work)
            sizes = np.diff(i) + np.diff(j)
            assert i[-1] == n and j[-1] == m and (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all()
            assert (sizes <= work + 1).all() and (sizes[:-1] >= work - 1).all()
            x, y = alignment.merged(a, b, work)
            assert (a[x] == both).all() and (b[y] == both).all()


def test_ranks_give_the_same_ids_for_settled_characters(libraries):
    with open(FILES[0], encoding="utf-8") as a, open(FILES[1], "rb") as b, open(FILES[2], encoding="utf-8") as r:
        pair = alignment.Pair(a.read(), b.read(), r.read(), public.PATTERN)
    settled = [chr(c) for c in range(0x3000) if alignment.SETTLED.fullmatch(chr(c))]
    rnd = random.Random(7)
    texts = [f(c) for c in settled for f in (lambda c: c, lambda c: f"a{c}b {c}{c} 1{c}2", lambda c: f"{c} {c}\n\n {c}'s")]
    texts += ["".join(rnd.choice(settled) for _ in range(40)) for _ in range(3000)] + ["".join(rnd.choice(" \n\t a'") for _ in range(60)) for _ in range(2000)]
    got, _ = pair.encode(texts)
    assert got == [e.ids for e in libraries[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]
