"""WARC archives: written, read back, reassembled; foreign and broken ones."""

import base64
import gzip
import hashlib
import itertools
import random

import pytest

from loam.llm import warc

PAGES = "page_id long, url string, html string, sha1 string, size int, record_type string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], PAGES)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def brute(rows):
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    out = []
    for page, _, html in rows:
        raw, one = (html or "").encode(), first.get(html or "")
        again = one is not None and page != one
        out.append((page, len(raw), digest(raw), "revisit" if again else "response", one if again else None))
    return sorted(out, key=repr)


def test_pages_come_back(spark):
    rnd = random.Random(3)
    copy = "<p>copy é 漢</p>" * 900
    rows = [(i, f"http://h/{i}", "".join(rnd.choice("aé漢\r\n<>") for _ in range(rnd.choice([0, 1, 2046, 2048, 2049, 9000, 30000])))) for i in range(60)]
    rows += [(100 + i, "http://copy", copy) for i in range(40)] + [(99, "u", copy), (7000, "u", None), (7001, None, "")]
    rows += [(200, "a\r\nWARC-Type: x b", "WARC/1.1\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"), (201, "é", "<b>same page twice</b>"), (201, "é", "<b>same page twice</b>"), (202, "", "<b>same page twice</b>")]
    rows += [(None, "n", "no id"), (None, "n", "no id"), (None, "m", copy)]
    got = sorted((tuple(r) for r in warc.archived(pages_of(spark, rows)).collect()), key=repr)
    assert got == brute(rows)
    assert warc.archived(pages_of(spark, [])).count() == 0


def test_payloads_and_files(spark, tmp_path):
    rows = [(i, f"http://h/{i} x", "é" * n) for i, n in enumerate([0, 3, 1000, 1001, 5000])]
    path = str(tmp_path / "archives")
    warc.write_archives(pages_of(spark, rows).coalesce(1), path, segment=999, file_records=4)
    back = warc.read_archives(spark, path).collect()
    assert {r.page_id: r.payload.decode() for r in back} == {i: html for i, _, html in rows}
    assert all(r.status == "ok" and r.target_uri == f"http://h/{r.page_id}%20x" and r.payload_digest == digest(bytes(r.payload)) for r in back)
    files = [gzip.decompress(f.read_bytes()) for f in (tmp_path / "archives").glob("*.gz")]
    kinds = [[named["warc-type"] for named, _ in warc.read_records(f)] for f in files]
    assert all(len(k) <= 4 for k in kinds) and sum(k.count("continuation") for k in kinds) > 10
    assert all("error" not in k for k in kinds)


def test_chunk_framing():
    for size, n in itertools.product((1, 7, 2048), (0, 1, 6, 7, 8, 5000)):
        raw = bytes(range(256)) * 20
        assert warc.unchunked(warc.chunked(raw[:n], size)) == raw[:n]
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for broken in (b"", b"3\r\nab", b"3\r\nabcd\r\n0\r\n\r\n", b"x\r\n", b"3\r\nabc\r\n", b"-1\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(broken)
    assert warc.http_payload(b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\nplain") == b"plain"
    assert warc.http_payload(b"HTTP/1.1 200 OK\r\nTRANSFER-ENCODING:  Chunked \r\n\r\n1\r\na\r\n0\r\n\r\n") == b"a"


def write(folder, name, records, squeeze=False):
    raw = b"".join(r + b"\r\n\r\n" for r in records)
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(gzip.compress(raw) if squeeze else raw)


def test_segments_in_any_order_and_broken_ones(spark, tmp_path):
    html = b"<p>" + b"word " * 400 + b"</p>"
    make = lambda i, **k: list(warc.records_of(f"urn:x:{i}", i, "u", hashlib.sha1(html).hexdigest(), html, None, False, segment=500))
    whole, shuffled, twice, hole, headless, cut, longer, wrong = (make(i) for i in range(8))
    rnd = random.Random(1)
    rnd.shuffle(shuffled)
    twice += twice[1:3]
    del hole[2]
    del headless[0]
    del cut[-1]
    longer[-1] = longer[-1].replace(b"WARC-Segment-Total-Length: ", b"WARC-Segment-Total-Length: 9")
    wrong[1] = wrong[1].replace(b"word", b"wort")
    folder = tmp_path / "a"
    write(folder, "one.warc", [*whole, *shuffled[:2], *twice, warc.record("warcinfo", "<i>", b"x"), warc.record("metadata", "<m>", b"")])
    write(folder, "two.warc.gz", [*shuffled[2:], *hole, *headless, *cut], squeeze=True)
    write(folder, "three.warc", [*longer, *wrong, warc.record("response", "<plain>", b"HTTP/1.0 200 OK\r\n\r\nabc")])
    (folder / "bad.warc").write_bytes(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort")
    (folder / "noise.warc.gz").write_bytes(b"\x1f\x8bnoise")
    (folder / "negative.warc").write_bytes(b"WARC/1.1\r\nContent-Length: -5\r\n\r\n")
    (folder / "empty.warc").write_bytes(b"")
    rows = warc.read_archives(spark, str(folder)).collect()
    by = {r.record_id: r for r in rows if r.record_id}
    assert len(rows) == 8 + 1 + 3 and sum(r.record_type is None for r in rows) == 3
    assert all(by[f"<urn:x:{i}>"].status == "ok" and bytes(by[f"<urn:x:{i}>"].payload) == html for i in (0, 1, 2))
    said = [by[f"<urn:x:{i}>"].status for i in range(3, 8)]
    assert said == ["a segment is missing or differs", "a segment is missing or differs", "the last segment is missing", "the segments are not as long as their total", "payload differs from its digest"]
    assert all(by[f"<urn:x:{i}>"].payload is None for i in range(3, 8)) and bytes(by["<plain>"].payload) == b"abc" and by["<plain>"].page_id is None
