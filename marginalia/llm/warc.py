"""WARC archives: writing, segment reassembly and chunked transfer decoding.

`write_archives` writes one record per page: `response` records with the HTTP
block in chunked framing, and `revisit` records for pages whose payload
another page already holds.  A block over `segment_bytes` is cut: the first
segment stays in the main file, its continuation records go to a second file
and name the origin record, their segment number and, on the last one, the
total length.

`read_archives` reads any such archives: records are parsed file by file,
the segments of a record are brought together by origin identifier, ordered
by number, checked against the announced total length, and the chunked
framing is decoded; the payload is checked against its digest.

Defined cases: a null html is an empty payload; pages with equal payloads and
the same (largest) page_id are all responses; a page without page_id never is
the one that others refer to unless none of them has one; a null url writes
no target field; an empty table gives an empty result.  Damaged records
(missing or repeated segments, wrong lengths, bad chunk framing, wrong
digest) come out with `error` set and no payload instead of failing the job.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, segments int, payload binary, error string"
PARTS = "origin string, number int, total long, last boolean, block binary, " + RECORD
MANIFEST = "path string, records long"
#: Payloads held by so many pages that one task should not get them all; at most so many rows are broadcast.
HOT_PAYLOADS = 1000


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    out = []
    for k in range(0, len(payload), size):
        part = payload[k : k + size]
        out.append(b"%x\r\n%s\r\n" % (len(part), part))
    out.append(b"0\r\n\r\n")
    return b"".join(out)


def dechunk(data: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size without an end")
        size = int(data[at:end].split(b";")[0].strip() or b"-", 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if size < 0 or data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk of a wrong length")
        out.append(data[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> tuple[bytes, dict[str, str]]:
    """Payload and header fields of an HTTP response block."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        raise ValueError("HTTP header without an end")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("latin-1")
    return (dechunk(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body), fields


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return gzip.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n", 5, mtime=0)


def records_of(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record in a file."""
    with common.open_stream(uri) as raw, gzip.GzipFile(fileobj=raw) as f:
        while True:
            line = f.readline()
            while line == b"\r\n":
                line = f.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{uri}: not a record: {line[:40]!r}")
            fields = {}
            while (line := f.readline()) not in (b"\r\n", b""):
                name, _, value = line.decode("utf-8").partition(":")
                fields[name.strip().lower()] = value.strip()
            yield fields, f.read(int(fields["content-length"]))


def with_types(pages: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """page_id, url, html, refers_to (null: a response).

    Payload groups are counted with partial sums; the few largest ones are
    looked up by broadcast, of at most HOT_PAYLOADS rows, and all others by a
    join on the digest, in which the rows of hot payloads are spread.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("_d", F.sha1(F.encode("html", "UTF-8")))
    copies = rows.filter(F.octet_length("html") >= min_revisit_bytes).groupBy("_d").agg(F.count("*").alias("_n"), F.max("page_id").alias("_to")).filter("_n > 1")
    copies = common.materialize(copies, "copies")
    hot = copies.orderBy(F.desc("_n"), "_d").limit(HOT_PAYLOADS).select("_d", F.col("_to").alias("_hot"))
    rows = rows.join(F.broadcast(hot), "_d", "left")
    rows = rows.withColumn("_k", F.when(F.col("_hot").isNull(), F.col("_d")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id").cast("string"))))
    cold = copies.join(F.broadcast(hot), "_d", "left_anti").select(F.col("_d").alias("_k"), F.col("_to").alias("_cold"))
    rows = rows.join(cold, "_k", "left").withColumn("_to", F.coalesce("_hot", "_cold"))
    # <=> for the pages without an id
    return rows.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("_to")), F.col("_to")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, segment_bytes: int = 4096, chunk_bytes: int = 1500, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write one record per page; returns the manifest (path string, records long)."""
    common.small_batches(pages.sparkSession)
    schema = common.arrow_schema(MANIFEST)

    def put(batches):
        files = []

        def file(kind):
            f = common.AtomicFile(f"{folder}/{kind}-{uuid.uuid4().hex}.warc.gz")
            f.name, f.records = f"{folder}/{f.path.rpartition('/')[2]}", 0
            files.append(f)
            f.write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
            return f

        main = more = None
        for page_id, url, html, to in (r.values() for batch in batches for r in batch.to_pylist()):
            main = main or file("pages")
            payload = html.encode("utf-8", "surrogatepass")
            me = f"<urn:uuid:{uuid.uuid4()}>"
            common_fields = [("WARC-Record-ID", me), ("WARC-Date", date), ("WARC-Target-URI", None if url is None else " ".join(url.split())), ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("Content-Type", "application/http;msgtype=response")]
            status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            main.records += 1
            if to is not None:
                profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                main.write(record([("WARC-Type", "revisit"), ("WARC-Profile", profile), ("WARC-Refers-To-Page-ID", to), *common_fields], status + b"Content-Length: %d\r\n\r\n" % len(payload)))
                continue
            block = status + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
            cut = [block[k : k + segment_bytes] for k in range(0, len(block), segment_bytes)]
            main.write(record([("WARC-Type", "response"), ("WARC-Segment-Number", 1 if len(cut) > 1 else None), *common_fields], cut[0]))
            for n, part in enumerate(cut[1:], 2):
                more = more or file("continuations")
                more.records += 1
                more.write(record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Segment-Origin-ID", me), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", len(block) if n == len(cut) else None)], part))
        for f in files:
            f.close()
        if files:
            yield pa.RecordBatch.from_pylist([{"path": f.name, "records": f.records} for f in files], schema)

    return common.materialize(with_types(pages, min_revisit_bytes).mapInArrow(put, MANIFEST), "manifest")


def finish(row: dict, block: bytes, keep_payload: bool) -> dict:
    """Fill in what the whole block of a response says."""
    try:
        payload, _ = payload_of(block)
        if row["payload_digest"] is not None and digest_of(payload) != row["payload_digest"]:
            raise ValueError("payload digest differs")
        row |= {"payload_digest": digest_of(payload), "payload_bytes": len(payload), "payload": payload if keep_payload else None}
    except ValueError as e:
        row["error"] = str(e)
    return row


def names_of(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def read_archives(spark: SparkSession, manifest: DataFrame, keep_payload: bool = True) -> DataFrame:
    """The response and revisit records of archives listed in `path`, put together again."""

    part_schema, record_schema = common.arrow_schema(PARTS), common.arrow_schema(RECORD)

    def parse(batches):
        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for fields, block in records_of(path):
                    kind = fields.get("warc-type")
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    digest, number = fields.get("warc-payload-digest"), fields.get("warc-segment-number")
                    row = {"origin": fields.get("warc-segment-origin-id", fields["warc-record-id"]), "number": int(number) if number else None, "last": kind == "continuation" and "warc-segment-total-length" in fields, "record_type": kind, "url": fields.get("warc-target-uri"), "payload_digest": digest.rpartition(":")[2] if digest else None, "segments": 1}
                    for name, field in (("page_id", "warc-page-id"), ("refers_to", "warc-refers-to-page-id"), ("total", "warc-segment-total-length")):
                        row[name] = int(fields[field]) if field in fields else None
                    if kind == "revisit":
                        row["payload_bytes"] = int(payload_of(block)[1].get("content-length", 0))
                    elif row["number"] is None:
                        row = finish(row, block, keep_payload)
                    else:
                        row["block"] = block
                    rows.append(row)
                    held += len(block)
                    if len(rows) >= 2000 or held > 16_000_000:
                        yield pa.RecordBatch.from_pylist(rows, part_schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, part_schema)

    def put_together(batches):
        names, out = names_of(RECORD), []
        origin, head, blocks, numbers, total = None, None, [], [], None

        def whole():
            row = head or {"error": "continuations without their origin", "record_type": "continuation"}
            row["segments"] = len(blocks)
            block = b"".join(blocks)
            if head is None:
                return row
            if numbers != list(range(1, len(numbers) + 1)):
                return row | {"error": "segments missing or repeated"}
            if total is None or total != len(block):
                return row | {"error": "total length differs"}
            return finish(row, block, keep_payload)

        for batch in batches:
            for r in batch.to_pylist():
                if r["block"] is None:
                    out.append({c: r[c] for c in names})
                else:
                    if r["origin"] != origin:
                        if origin is not None:
                            out.append(whole())
                        origin, head, blocks, numbers, total = r["origin"], None, [], [], None
                    if r["record_type"] == "response":
                        head = {c: r[c] for c in names}
                    total = r["total"] if r["total"] is not None else total
                    blocks.append(r["block"])
                    numbers.append(r["number"])
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_pylist(out, record_schema)
                    out = []
        if origin is not None:
            out.append(whole())
        if out:
            yield pa.RecordBatch.from_pylist(out, record_schema)

    files = max(1, manifest.count())
    parts = manifest.select("path").repartition(files).mapInArrow(parse, PARTS)
    return parts.repartition(F.col("origin")).sortWithinPartitions("origin", "number").mapInArrow(put_together, RECORD)


def round_trip(spark: SparkSession, pages: DataFrame, keep_payload: bool = False, **options) -> DataFrame:
    """Archives of all pages in the shared folder, read back."""
    return read_archives(spark, write_archives(pages, common.new_folder(spark, "warc"), **options), keep_payload)
