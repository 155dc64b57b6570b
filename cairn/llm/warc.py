"""WARC archives: written with one gzip member a record, and read back record by record.

Reading is sequential and incremental: compressed blocks go through zlib, a member ends where zlib says so, the header
block ends at an empty line, and the payload is as long as Content-Length says; its SHA-1 must match
WARC-Payload-Digest. No more than one record and one block are in memory.

Duplicates: of records with equal payloads of at least min_bytes the one with the largest id holds the payload
(response), the others revisit it. Digests are grouped by partial aggregation, and AQE splits a hot digest in the join.

Files go to the session's shared folder through pyarrow.fs, for the schemes that common.store() names. A task
writes under a name of its own attempt, and only the names that successful tasks report are read: a lost executor's
retry can't mix two attempts.

Defined cases: a null payload is empty; a null url is written without WARC-Target-URI; rows that repeat an id are
records of their own, and all responses where that id is the largest of its group; a null id is the smallest. A corrupt member, a short record or a wrong
digest raises.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_folder, slices, store, table

BLOCK = 1 << 16
LEVEL = 4


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(ident: str, uri: str | None, kind: str, payload: bytes, sha1: str, refers_to: str | None = None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record, not compressed. A revisit holds no payload; its digest and length are the full payload's."""
    body = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{ident}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/octet-stream", f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(body)}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(raw: bytes, level: int = LEVEL) -> bytes:
    """raw as one gzip member."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def members(stream, block: int = BLOCK) -> Iterator[bytes]:
    """The records of a stream of gzip members, one at a time."""
    rest = b""
    while rest or (rest := stream.read(block)):
        z, parts = zlib.decompressobj(31), []
        while True:
            parts.append(z.decompress(rest))
            rest = z.unused_data
            if z.eof:
                break
            if not (rest := stream.read(block)):
                raise ValueError("the archive ends inside a gzip member")
        yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, by lower-case name, and the payload of one record; raises where framing or digest is wrong."""
    end = raw.find(b"\r\n\r\n")
    lines = raw[:end].decode("utf-8", "surrogatepass").split("\r\n")
    if end < 0 or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(head["content-length"])
    body = raw[end + 4 : end + 4 + n]
    if len(body) != n or raw[end + 4 + n :] != b"\r\n\r\n":
        raise ValueError("Content-Length and record differ")
    if head["warc-type"] == "response" and "sha1:" + digest(body) != head["warc-payload-digest"]:
        raise ValueError("payload and digest differ")
    return head, body


def plan(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, body) with kind and refers_to. One row of each group of equal payloads is the response."""
    rows = pages.withColumn("sha", F.sha1("body")).withColumn("n", F.octet_length("body"))
    best = rows.where(F.col("n") >= min_bytes).groupBy(F.col("sha").alias("s")).agg(F.max("page_id").alias("best"), F.count("*").alias("copies")).where("copies > 1")
    return rows.join(best, (F.col("sha") == F.col("s")) & (F.col("n") >= min_bytes), "left").select("page_id", "url", "body", (F.col("copies").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))).alias("revisit"), F.when(~F.col("page_id").eqNullSafe(F.col("best")), F.col("best")).alias("refers_to"))


def write(planned: DataFrame, folder: str) -> DataFrame:
    """Archives in folder, one a task; (path, records) of each."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(folder)
        name, out, n = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for b in slices(batches, 2):
            for ident, url, body, revisit, best in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                out.write(member(record("" if ident is None else str(ident), url, "revisit" if revisit else "response", body, digest(body), str(best))))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": pa.array([f"{folder}/{name}"]), "records": pa.array([n], pa.int64())})

    return cut(planned.mapInArrow(f, "path string, records long"), "archives")


def read(archives: DataFrame) -> DataFrame:
    """Every record of the archives (path): page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for a revisit)."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def number(x: str) -> int | None:
        x = x.removeprefix("<urn:page:").removesuffix(">")
        return int(x) if x else None

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = store(path)
                rows, held = [], 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for raw in members(stream):
                        head, body = parse(raw)
                        kind = head["warc-type"]
                        rows.append((number(head["warc-record-id"]), head.get("warc-target-uri"), int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:"), kind, number(head["warc-refers-to"]) if kind == "revisit" else None, body if kind == "response" else None))
                        held += len(body)
                        if len(rows) >= 512 or held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    n = max(1, archives.count())
    return archives.select("path").repartition(n).mapInArrow(f, schema)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archives pages (page_id, url, html) in the shared folder and reads them back."""
    spark = pages.sparkSession
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("body")
    planned = plan(pages.select("page_id", "url", body), min_bytes)
    return read(write(planned, f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, as read back from the archives."""
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS sha, max(page_id) OVER (PARTITION BY sha1(body)) AS best FROM p),
b AS (SELECT *, list_aggregate(list_transform(string_split(sha, ''), lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', c)]), 'string_agg', '') AS bits FROM h)
SELECT page_id, n AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to FROM b
"""
