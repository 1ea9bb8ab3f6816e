"""Exact, near and substring deduplication against brute force."""

import hashlib
import random
import re
import string

import numpy as np
import xxhash

from loam.llm import chunks, exact, near, simhash

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def exact_by_hand(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(SPACES.sub(" ", text or ""), []).append(i)
    out, done = [], set()
    for i, text in rows:
        norm = SPACES.sub(" ", text or "")
        ids = [x for x in groups[norm] if x is not None]
        keep = min(ids) if ids else None
        kept = i == keep and norm not in done
        if kept:
            done.add(norm)
        out.append((i, keep, len(groups[norm]), kept, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [
    (5, "a b"), (3, "a \t\n b"), (9, "a b "), (4, None), (2, ""), (7, "x" * 300_000), (1, "x" * 300_000), (8, "é ü"), (8, "é ü"), (8, "é  ü"), (8, "other"),
    (None, "a b"), (None, "only null"), (None, "only null"), (11, " "), (12, "\x0b"), (13, "\x1c"), (14, "A b"), (15, "a\u00a0b"),
]


def test_exact_duplicates(spark, documents):
    got = exact.exact_duplicates(documents(ROWS)).collect()
    assert sorted(map(tuple, got), key=repr) == exact_by_hand(ROWS)
    assert exact.exact_duplicates(documents([])).count() == 0


def test_exact_keeps_one_row_of_each_text(spark, documents):
    got = exact.without_duplicates(documents(ROWS))
    assert got.columns[-3:] == ["size", "digest", "id"]
    texts = [SPACES.sub(" ", r.text or "") for r in got.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {SPACES.sub(" ", t or "") for _, t in ROWS}
    assert exact.without_duplicates(documents([])).count() == 0


def keyed(documents, rows):
    from pyspark.sql import functions as F

    norm = exact.normalised(F.col("text"))
    return documents(rows).select("doc_id", F.unhex(F.sha2(norm, 256)).alias("digest"), F.monotonically_increasing_id().alias("row"))


def test_index_takes_more_batches(spark, documents):
    index = exact.DigestIndex(spark, fanout=2)
    name = {hashlib.sha256(t.encode()).digest(): t for t in "abcdxyz"}
    hits = lambda rows: sorted(name[bytes(r.digest)] for r in index.flush(keyed(documents, rows)).collect())
    assert hits([(5, "a"), (6, "b"), (5, "a")]) == ["a"]
    assert hits([(2, "a"), (9, "c")]) == ["a"] and [len(x) for x in index.levels] == [0, 1]
    assert hits([(1, "d"), (7, "b")]) == ["b"] and [len(x) for x in index.levels] == [1, 1]
    found = index.lookup(keyed(documents, [(0, "b"), (0, "x"), (0, "c")]).select("digest"))
    assert sorted((name[bytes(r.digest)], r.keep_id) for r in found.collect()) == [("b", 6), ("b", 7), ("c", 9)]
    assert hits([(None, "z")]) == [] and [len(x) for x in index.levels] == [0, 0, 1]  # compacted twice
    entries = {name[bytes(r.digest)]: (r.keep_id, r.rows) for r in index.compact().collect()}
    assert entries == {"a": (2, 3), "b": (6, 2), "c": (9, 1), "d": (1, 1), "z": (None, 1)} and len(index.runs()) == 1
    assert exact.DigestIndex(spark).compact().count() == 0


def test_filter_loses_nothing(spark, documents):
    held, asked = keyed(documents, [(i, f"h{i}") for i in range(300)]), keyed(documents, [(i, f"{'hx'[i % 2]}{i}") for i in range(600)])
    for bits, most in ((1 << 26, 3), (64, 600)):  # a filter that is nearly empty, and one that is full
        passed = {r.doc_id for r in exact.maybe_in(asked, exact.filter_of(held, bits), bits).collect()}
        assert set(range(0, 300, 2)) <= passed and len(passed) <= 150 + most


def test_digest_clashes_are_told_apart_by_bytes(spark, documents):
    from pyspark.sql import functions as F

    for key in (lambda d: F.substring(d, 1, 1), lambda d: F.lit(b"x")):
        got = exact.exact_duplicates(documents(ROWS), flushes=3, fanout=2, bits=64, key=key).collect()
        assert sorted(map(tuple, got), key=repr) == exact_by_hand(ROWS)


def print_by_hand(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_by_hand(rows):
    prints = [print_by_hand(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                label[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return sorted(((d, f"{prints[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def near_rows():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice(string.ascii_letters + "éß") for _ in range(rnd.randrange(2, 8)))
    base = [[word() for _ in range(n)] for n in (400, 250, 90, 3, 2, 1)]
    rows = [(100 - i, " ".join(b)) for i, b in enumerate(base)]
    for k in range(40):
        b = list(rnd.choice(base[:3]))
        for _ in range(rnd.randrange(0, 3)):
            b[rnd.randrange(len(b))] = word()
        rows.append((200 + k, ("\n" if k % 2 else "  ").join(b)))
    return rows + [(50, None), (51, ""), (52, " \t"), (None, rows[0][1]), (99, rows[1][1]), (99, rows[1][1]), (60, "so " * 70_000), (61, "so so"), (62, "SO so so")]


def test_near_duplicates(spark, documents):
    rows = near_rows()
    want = near_by_hand(rows)
    assert len({r[2] for r in want}) < len(want) - 5
    for wide in (4096, 1):  # every bucket dealt out a second time
        got = simhash.near_duplicates(documents(rows), wide=wide).collect()
        assert sorted(map(tuple, got), key=repr) == want
    assert simhash.near_duplicates(documents([])).count() == 0


def test_one_of_each_near_group(spark, documents):
    rows = near_rows()
    kept = simhash.one_of_each(documents(rows))
    want = {d for d, _, c in near_by_hand(rows) if d == c and d is not None}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want) and kept.columns[-1] == "id"


def test_one_of_each_without_identifiers(spark, documents):
    rnd = random.Random(12)
    lone = [passage(rnd, 60) for _ in range(5)]
    twice = [passage(rnd, 60), passage(rnd, 60)]  # two texts of one doc_id
    known = passage(rnd, 60)
    rows = [(None, t) for t in lone] + [(None, lone[0]), (7, twice[0]), (7, twice[1]), (7, twice[1]), (8, known), (None, known), (2**63 - 1, passage(rnd, 60))]
    want = sorted([*lone, *twice, known, rows[-1][1]])
    for kept in (simhash.one_of_each(documents(rows)), near.one_of_each(documents(rows))):
        got = kept.collect()
        assert sorted(r.text for r in got) == want
        assert {r.doc_id for r in got if r.text == known} == {8} and sum(r.doc_id is None for r in got) == 5


def jaccard(a, b, n=5):
    sets = []
    for text in (a, b):
        words = [w for w in SPACES.split((text or "").lower()) if w]
        sets.append({tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else {()})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_one_of_each_takes_all_similar_pairs(spark, documents):
    rnd = random.Random(21)
    rows, bits = [(900, None), (901, " "), (902, "two words"), (903, "Two  words"), (904, "two word")], []
    for i in range(30):
        base = passage(rnd, rnd.randrange(60, 400)).split()
        rows.append((10 * i, " ".join(base)))
        for k in range(1, 4):  # one to several changed words
            other = list(base)
            for _ in range(max(1, len(base) * rnd.randrange(4, 35) // 1000)):
                other[rnd.randrange(len(other))] = passage(rnd, 1)
            rows.append((10 * i + k, " ".join(other).upper() if k == 3 else "\n".join(other)))
            bits.append(bin(print_by_hand(rows[-1][1]) ^ print_by_hand(" ".join(base))).count("1"))
    label = {d: d for d, _ in rows}

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    near_pairs = 0
    for i, (d, a) in enumerate(rows):
        for e, b in rows[:i]:
            if (d // 10 == e // 10 or d >= 900) and jaccard(a, b) >= 0.8:
                near_pairs += 1
                label[max(find(d), find(e))] = min(find(d), find(e))
    want = sorted({find(d) for d, _ in rows})
    assert sum(b > 3 for b in bits) > 20 and near_pairs > 40 and len(want) > 31
    assert sorted(r.doc_id for r in near.one_of_each(documents(rows)).collect()) == want
    assert near.one_of_each(documents([])).count() == 0


def test_prefixes_lose_no_similar_pair(spark):
    rnd = random.Random(3)
    sets = {}
    for i in range(60):  # sets that grew and changed from one another, some far apart in size
        base = list(sets[rnd.choice(list(sets))]) if sets and rnd.random() < 0.9 else rnd.sample(range(10**6), rnd.randrange(1, 60))
        for _ in range(rnd.randrange(0, 1 + len(base) // 7)):
            base[rnd.randrange(len(base))] = rnd.randrange(10**6)
        sets[i] = set(base[: rnd.randrange(max(1, len(base) * 9 // 10), len(base) + 1)] + rnd.sample(range(10**6), rnd.randrange(0, 2)))
    nodes = spark.createDataFrame([(i, i % 50, len(s)) for i, s in sets.items()], "node long, label long, n long")
    table = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "node long, shingles array<long>")
    got = {(r.u, r.v) for r in near.prefix_pairs(nodes, table, 0.8).collect()}
    want = {(i, j) for i in sets for j in sets if i < j and i % 50 != j % 50 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert want <= got and len(want) > 30 and len(got) < 60 * 59 // 4


def test_variants_that_changed_other_words_are_not_paired(spark, documents):
    rnd = random.Random(8)
    base = passage(rnd, 300).split()
    rows = [(1000, " ".join(base))]
    for i in range(120):
        own = list(base)
        for _ in range(rnd.randrange(4, 12)):  # some within 0.8 of the base
            own[rnd.randrange(300)] = passage(rnd, 1)
        rows.append((i, " ".join(own)))
    label = {d: d for d, _ in rows}

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for i, (d, a) in enumerate(rows):
        for e, b in rows[:i]:
            if jaccard(a, b) >= 0.8:
                label[max(find(d), find(e))] = min(find(d), find(e))
    want = sorted({find(d) for d, _ in rows})
    assert 10 < len(want) < 121
    assert sorted(r.doc_id for r in near.one_of_each(documents(rows)).collect()) == want


def test_every_pair_in_the_radius_meets():
    rnd = random.Random(2)
    for _ in range(2000):
        bits = rnd.sample(range(64), rnd.randrange(1, 4))
        x = sum(1 << b for b in bits)
        tables = [i for i, m in enumerate(simhash.MASKS) if not x & m]
        assert tables and all(any(not x & m for m in simhash.FINER[i]) for i in tables)


def test_spanning_links_keep_components():
    rnd = np.random.default_rng(1)
    seeds = rnd.integers(0, 1 << 63, 5, dtype=np.uint64)
    fps = np.unique(np.concatenate([s ^ (np.uint64(1) << rnd.integers(0, 20, 30, dtype=np.uint64)) for s in seeds]))
    links = simhash.spanning_links(fps)
    pairs = sum(bin(int(a) ^ int(b)).count("1") <= 3 for i, a in enumerate(fps) for b in fps[:i])
    assert len(links) == len(fps) - 5 < pairs


def passage(rnd, n):
    return " ".join("".join(rnd.choice(string.ascii_lowercase) for _ in range(rnd.randrange(2, 9))) for _ in range(n))


def test_repeated_passages_are_found_at_any_shift(spark, documents):
    rnd = random.Random(4)
    shared = [passage(rnd, 55) for _ in range(6)]
    rows = [(i, f"{passage(rnd, 20 + 7 * i)} {shared[i % 6]} {passage(rnd, 30)}") for i in range(24)]
    rows += [(100 + i, passage(rnd, 150)) for i in range(20)] + [(200, None), (201, ""), (None, shared[0]), (7, rows[7][1]), (202, "so " * 100_000)]
    spans = chunks.repeated_spans(documents(rows)).collect()
    assert {r.doc_id for r in spans} == set(range(24))
    text = dict(rows)
    for r in spans:
        assert r.first_doc_id == r.doc_id % 6 and r.kept == (r.doc_id < 6) and r.n_bytes == r.stop - r.start
        found = text[r.doc_id].encode()[r.start : r.stop].decode()
        assert found in text[r.first_doc_id] and r.n_bytes > 200
    assert chunks.repeated_spans(documents([])).count() == 0


def cuts_by_hand(raw):
    """A cut follows a byte whose hash is the least of 16 on either side."""
    h = [sum(int(chunks.GEAR[raw[i - j]]) << j for j in range(min(16, i + 1))) % 2**64 for i in range(len(raw))]
    ends, before = [], -16
    for i in range(len(raw)):
        if h[i] == min(h[max(0, i - 16) : i + 17]) and i + 1 < len(raw) and i + 1 - before > 16:
            ends.append(i + 1)
            before = i + 1
    out, at = [], 0
    for e in [*ends, len(raw)] if raw else []:
        out += [*range(at + chunks.LONGEST, e, chunks.LONGEST), e]
        at = e
    return out


def spans_by_hand(rows, least=chunks.SPAN):
    docs = {}
    for i, text in rows:
        if i is not None and text:
            docs.setdefault(i, set()).add(text.encode())
    held, parts = {}, {}
    for i, texts in docs.items():
        for raw in texts:
            for a, b in zip([0, *(e := cuts_by_hand(raw))], e):
                held.setdefault(raw[a:b], set()).add(i)
                parts.setdefault(i, {}).setdefault((a, b), raw[a:b])
    out = []
    for i, places in parts.items():
        run = []
        for (a, b), chunk in sorted(places.items()) + [((-1, -1), None)]:
            if run and (chunk is None or len(held[chunk]) == 1 or run[-1][1] != a):
                first = [min(held[c]) for *_, c in run]
                if run[-1][1] - run[0][0] >= least:
                    dup = sum(y - x for (x, y, _), f in zip(run, first) if f < i)
                    out.append((i, run[0][0], run[-1][1], run[-1][1] - run[0][0], min(first), dup, dup == 0))
                run = []
            if chunk is not None and len(held[chunk]) > 1:
                run.append((a, b, chunk))
    return sorted(out)


def test_repeated_spans_as_by_hand(spark, documents):
    rnd = random.Random(14)
    shared = [passage(rnd, n) for n in (8, 25, 55, 90)] + ["ab" * 400, "é" * 300]
    rows = [(1000, None), (1001, ""), (1002, "x"), (None, shared[3])]
    for i in range(40):
        pieces = [rnd.choice(shared) if rnd.random() < 0.5 else passage(rnd, rnd.randrange(1, 60)) for _ in range(rnd.randrange(1, 6))]
        rows.append((i, " ".join(pieces)))
    got = sorted(map(tuple, chunks.repeated_spans(documents([*rows, rows[9]])).select("doc_id", "start", "stop", "n_bytes", "first_doc_id", "dup_bytes", "kept").collect()))
    assert got == spans_by_hand(rows) and len(got) > 30


def test_repeats_are_cut_out(spark, documents):
    rnd = random.Random(8)
    shared = passage(rnd, 80)
    rows = [(1, f"{passage(rnd, 20)} {shared}"), (2, f"{shared} {passage(rnd, 20)}"), (3, passage(rnd, 90)), (4, None)]
    got = {r.doc_id: r.text for r in chunks.without_repeats(documents(rows)).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1] and got[4] is None
    assert len(got[2]) < len(rows[1][1]) - 300 and got[2].endswith(rows[1][1][-60:])


def test_cuts_are_local_whatever_the_block(monkeypatch):
    rnd = random.Random(6)
    raw = passage(rnd, 3000).encode()
    whole = chunks.cuts(raw)
    monkeypatch.setattr(chunks, "BLOCK", 1000)
    assert (chunks.cuts(raw) == whole).all()
    monkeypatch.undo()
    moved = chunks.cuts(b"an insertion " + raw) - 13
    assert set(whole[3:]) <= set(moved)
    assert chunks.cuts(b"").size == 0 and chunks.cuts(b"a").tolist() == [1]
    assert np.diff(chunks.cuts(b"For " * 5000), prepend=0).max() <= chunks.LONGEST


def test_pipeline_stages_tell_repeats_apart(documents):
    """Of rows that repeat doc_id and normalised text the same stays in any order of rows,
    and texts that share a node's number are still told apart."""
    rows = [(1, "a  b", "x"), (1, "a b", "y"), (1, "a\tb", "x"), (1, "a b", "x"), (2, None, "x"), (2, "", "y")]
    kept = {tuple(sorted(map(str, exact.without_duplicates(documents(some)).select("doc_id", "text", "source").collect()))) for some in (rows, rows[::-1], rows[2:] + rows[:2])}
    assert len(kept) == 1 and len(next(iter(kept))) == 2
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[i : i + 30]) for i in (0, 1, 7, 20, 29, 30)] + ["", "one", "two words", "ONE"]
    docs = documents(list(enumerate(texts)))
    want = sorted(r.doc_id for r in near.one_of_each(docs).collect())
    assert want == sorted(r.doc_id for r in near.one_of_each(docs, node_bits=1).collect())
    assert {6, 7, 8} <= set(want) and 9 not in want
