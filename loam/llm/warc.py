"""WARC archives of web pages: written in segments, read back and reassembled.

A page is a response record whose block, an HTTP message with chunked transfer
framing, is cut into segments: the response itself and continuation records.
Pages with the payload of another one are revisit records without a payload.
Reading groups continuations by the identifier of their origin, orders them by
segment number, verifies the total length and takes the framing off again.

Archives are written by Spark's text writer, a record to a row with the two line
ends that close a record between rows, so they are committed and retried like any
other output and lie wherever Spark can write. They are read as binary files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dims import small
from .shared import scratch, store

#: Bytes of a block in one record, bytes of a chunk, and records in one file, which
#: bounds what a task reads at once.
SEGMENT, CHUNK, FILE_RECORDS = 8192, 2048, 16384
#: Pages carry no time of their capture.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n"
_TOGETHER = 8 << 20  # bytes in one Arrow batch


# -- records


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def header_value(text: str) -> str:
    """text with control characters and spaces percent-encoded, for one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", text)


def record(kind: str, identifier: str, block: bytes, **named: object) -> bytes:
    """A record without the line ends that close it; names have _ for -."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {identifier}", f"WARC-Date: {DATE}"]
    lines += [f"{n.replace('_', '-')}: {v}" for n, v in named.items() if v is not None]
    if block:
        lines.append("Content-Type: application/http; msgtype=response" if kind != "continuation" else "Content-Type: application/octet-stream")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + END + END + block


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """payload in chunked transfer framing."""
    out = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out += [b"%x\r\n" % len(part), part, END]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        line = body.find(END, at)
        if line < 0:
            raise ValueError("chunk size is missing")
        size = body[at:line].split(b";", 1)[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            raise ValueError("chunk size is no number")
        n, at = int(size, 16), line + 2
        if n == 0:
            return b"".join(out)  # trailing fields don't count
        if len(body) < at + n + 2 or body[at + n : at + n + 2] != END:
            raise ValueError("chunk is cut short")
        out.append(body[at : at + n])
        at += n + 2


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response, its transfer framing taken off."""
    end = block.find(END + END)
    if end < 0:
        raise ValueError("HTTP header has no end")
    named = re.search(rb"(?im)^transfer-encoding:[ \t]*([^\r\n]*?)[ \t]*\r?$", block[:end] + END)
    body = block[end + 4 :]
    return unchunked(body) if named and named.group(1).lower() == b"chunked" else body


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def records_of(identifier: str, page_id, url, sha1: str, payload: bytes, response_url, revisit: bool, segment: int = SEGMENT):
    """The records of one page, in order."""
    common = {"WARC_Target_URI": header_value(url) if url is not None else None, "WARC_Payload_Digest": f"sha1:{base32(sha1)}", "Page_ID": page_id}
    if revisit:
        yield record("revisit", f"<{identifier}>", HTTP, **common, WARC_Profile=PROFILE, WARC_Refers_To_Target_URI=header_value(response_url) if response_url is not None else None)
        return
    block = HTTP + chunked(payload)
    pieces = [block[at : at + segment] for at in range(0, len(block), segment)]
    yield record("response", f"<{identifier}>", pieces[0], **common, WARC_Segment_Number=1 if len(pieces) > 1 else None)
    for n, piece in enumerate(pieces[1:], 2):
        total = len(block) if n == len(pieces) else None
        yield record("continuation", f"<{identifier}:{n}>", piece, WARC_Segment_Origin_ID=f"<{identifier}>", WARC_Segment_Number=n, WARC_Segment_Total_Length=total)


def read_records(content: bytes):
    """Headers (names in lower case) and block of each record of an archive file,
    plain or gzip. Stops with a header {"error": ..} where a record can't be read."""
    raw = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 20) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    try:
        while True:
            line = raw.readline()
            while line in (b"\r\n", b"\n"):
                line = raw.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                raise ValueError("no record begins here")
            named = {}
            while (line := raw.readline().rstrip(b"\r\n")):
                name, _, value = line.partition(b":")
                named[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
            if not re.fullmatch(r"\d{1,15}", named.get("content-length", "")):
                raise ValueError("Content-Length is no number")
            size = int(named["content-length"])
            block = raw.read(size)
            if len(block) != size:
                raise ValueError("record is cut short")
            yield named, block
    except (ValueError, OSError, EOFError, zlib.error) as e:
        yield {"error": str(e) or type(e).__name__}, b""


# -- writing


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT, file_records: int = FILE_RECORDS) -> None:
    """Write a record for each row of pages (page_id, url, html) to archives at path.

    The payload is the html in UTF-8, a null one empty. Of pages with equal payloads
    the smallest page_id, null last, is the response; rows that repeat it are
    responses too, and all others are revisits. Payloads are told apart by SHA-1 and
    length. The repeated payloads are few or are joined by shuffle; pages whose
    payload is unique don't wait for that.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.cast("binary").alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("size"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("first")
    groups = rows.groupBy("sha1", "size").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").select("sha1", "size", "first")
    groups, _ = store(groups, "repeated")
    marked = rows.join(small(groups), ["sha1", "size"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    run = uuid.uuid4().hex

    def write(batches):
        task, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                for r in records_of(f"urn:loam:{run}:{task}:{n}", *row, segment):
                    held.append(r)
                    size += len(r)
                    if size > _TOGETHER:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])
                        held, size = [], 0
                n += 1
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])

    marked = marked.select("page_id", "url", "sha1", "payload", "first.url", revisit.alias("revisit")).toDF("page_id", "url", "sha1", "payload", "response_url", "revisit")
    out = marked.mapInArrow(write, "record binary").select(F.col("record").cast("string").alias("value"))
    out.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


# -- reading

_READ = "record_id string, record_type string, page_id long, target_uri string, payload_digest string, payload_bytes long, status string"


def _finished(named: dict, block: bytes | None, status: str, payloads: bool) -> dict:
    """A row of _READ for a record whose whole block is there."""
    payload = None
    if status == "ok" and named.get("warc-type") == "response":
        try:
            payload = http_payload(block)
        except ValueError as e:
            status = str(e)
    said = named.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if payload is not None:
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if said is not None and said.upper() != found:
            status, payload = "payload differs from its digest", None
        said = found if payload is not None else said
    page = named.get("page-id", "")
    row = {
        "record_id": named.get("warc-record-id"), "record_type": named.get("warc-type"), "page_id": int(page) if re.fullmatch(r"-?\d{1,19}", page) and abs(int(page)) < 1 << 63 else None,
        "target_uri": named.get("warc-target-uri"), "payload_digest": said, "payload_bytes": len(payload) if payload is not None else None, "status": status}
    return row | {"payload": payload} if payloads else row


def _batches(rows, schema: pa.Schema, weight):
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + weight(row)
        if size > _TOGETHER:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each response and revisit record of the archives at path: record_id,
    record_type, page_id, target_uri, payload_digest, payload_bytes, status and, if
    asked for, payload.

    status is ok, or says what is wrong: a segment missing or repeated with other
    bytes, a total length that is not met, broken chunks, another digest; the payload
    is null then, as it is for revisits. A file that can't be read on has a row with
    record_type null. A segment delivered twice counts once; continuations without
    their origin have a row with their origin's identifier. Only segments are
    shuffled; a task streams through them and holds one record at a time.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    schema = _READ + (", payload binary" if payloads else "")
    arrow = _arrow(schema)
    weight = lambda row: len(row.get("payload") or b"")

    def parsed(batches):
        for batch in batches:
            for content in batch.column("content"):
                yield from read_records(content.as_py())

    def whole(batches):
        rows = (
            _finished(named, block, named.get("error", "ok"), payloads) for named, block in parsed(batches)
            if "error" in named or named.get("warc-type") in ("response", "revisit") and "warc-segment-number" not in named)
        yield from _batches(rows, arrow, weight)

    segment = "origin string, number long, total long, named map<string,string>, block binary"
    segment_arrow = _arrow(segment)

    def segments(batches):
        number = lambda text: int(text) if text and re.fullmatch(r"\d{1,15}", text) else None
        rows = (
            {"origin": named.get("warc-segment-origin-id", named.get("warc-record-id")), "number": number(named["warc-segment-number"]),
             "total": number(named.get("warc-segment-total-length")), "named": list(named.items()) if named.get("warc-type") != "continuation" else None, "block": block}
            for named, block in parsed(batches) if "warc-segment-number" in named)
        yield from _batches(rows, segment_arrow, lambda row: len(row["block"]))

    def reassembled(batches):
        yield from _batches(_origins(batches, payloads), arrow, weight)

    ordered = files.mapInArrow(segments, segment).repartition("origin").sortWithinPartitions("origin", "number")
    return files.mapInArrow(whole, schema).unionByName(ordered.mapInArrow(reassembled, schema))


def _origins(batches, payloads: bool):
    """Rows of _READ from segments that come in the order of origin and number."""
    origin, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["origin"] != origin:
                yield _joined(origin, held, payloads)
                held = []
            origin = row["origin"]
            if held and held[-1]["number"] == row["number"] and held[-1]["block"] == row["block"]:
                continue  # delivered twice
            held.append(row)
    if held:
        yield _joined(origin, held, payloads)


def _joined(origin: str, segments: list[dict], payloads: bool) -> dict:
    named = next((dict(s["named"]) for s in segments if s["named"]), {"warc-record-id": origin, "warc-type": "response"})
    block = b"".join(s["block"] for s in segments)
    total = segments[-1]["total"]
    if [s["number"] for s in segments] != list(range(1, len(segments) + 1)):
        status = "a segment is missing or differs"
    elif total is None:
        status = "the last segment is missing"
    elif total != len(block):
        status = "the segments are not as long as their total"
    else:
        status = "ok"
    return _finished(named, block, status, payloads)


def resolved(records: DataFrame) -> DataFrame:
    """records of read_archives() without payload, with refers_to, for a revisit the
    smallest page_id of the responses with its digest, and the length of that payload
    as its own payload_bytes. Reads records twice. The responses are joined by digest,
    by shuffle unless those asked for are few; Spark splits a digest that many share."""
    asked = records.where("record_type = 'revisit'").select("payload_digest").distinct()
    responses = records.where("record_type = 'response' AND status = 'ok'").select("payload_digest", "page_id", "payload_bytes")
    originals = responses.join(asked, "payload_digest", "left_semi").groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.max("payload_bytes").alias("_bytes"))
    originals = originals.withColumn("record_type", F.lit("revisit"))  # so that responses find none
    joined = records.join(small(originals), ["payload_digest", "record_type"], "left")
    return joined.withColumns({"payload_bytes": F.coalesce("payload_bytes", "_bytes"), "refers_to": F.col("_first")}).drop("_first", "_bytes")


def archived(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each row of
    pages (page_id, url, html), written to archives and read back.

    Repeated rows each get a row, those of a response as responses; where only rows
    without page_id have a payload, all of them are responses. No rows give none;
    further columns are ignored. Archives and what is read from them stay in the
    shared folder.
    """
    spark = pages.sparkSession
    path = scratch(spark, "archives")
    write_archives(pages, path)
    records, _ = store(read_archives(spark, path, payloads=False), "records")
    return resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: For DuckDB; each page_id stands once.
SQL = """
WITH digested AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
first_ AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM digested)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::INT >> (5 * (3 - i % 4))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM first_"""
