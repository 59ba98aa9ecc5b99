"""WARC archives: writing, and the normaliser of monolithic gzip files.

A monolithic file holds all records in one gzip stream, so none can be read alone. The
normaliser inflates such a stream once, from start to end, rewrites every record as a gzip member of
its own and writes a sidecar index of offsets, one JSON line per record.

Archives go to the folder that all executors share. Names are unique to a task's attempt and only what a finished
attempt returns is read, so a lost executor leaves unused files at worst.

Edge cases: null payloads are empty; payloads under LEAST_REVISIT bytes are always responses. Of repeated rows with the smallest page_id each is a
response. A null page_id is written without the id and never is what others refer to; if no equal row has an id, all are responses. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, settle

#: Equal payloads from so many bytes on are written once.
LEAST_REVISIT = 100
#: Payload bytes of an archive file; the record that exceeds it is the file's last.
ARCHIVE_BYTES = 16_000_000
LEVEL = 1
_READ = 1 << 18
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """The bytes of a record; a revisit's block has the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {_DATE}"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def header_of(data: bytes) -> tuple[dict[str, str], int]:
    """The named fields of a record's header in lower case, and where its block begins."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}, end + 4


def inflated(source: BinaryIO) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, in parts."""
    d, rest, fed = zlib.decompressobj(31), b"", False
    while True:
        data = rest or source.read(_READ)
        rest = b""
        if not data:
            if fed:
                raise EOFError("the gzip stream is cut off")
            return
        out = d.decompress(data)
        fed = not d.eof
        if out:
            yield out
        if d.eof:
            rest = d.unused_data.lstrip(b"\0")
            d = zlib.decompressobj(31)


def records(parts: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records out of a stream of bytes; what is held is one record and a part."""
    held = bytearray()
    need = 0
    for part in parts:
        held += part
        while True:
            if not need:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                fields, body = header_of(bytes(held[: end + 4]))
                need = body + int(fields["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held.strip(b"\r\n"):
        raise EOFError("the last record is cut off")


def normalise(source: BinaryIO, target: BinaryIO, index: BinaryIO, level: int = LEVEL) -> int:
    """Rewrites a gzip file of WARC records with a member per record, and says in index where each is."""
    offset = n = 0
    for data in records(inflated(source)):
        c = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = c.compress(data) + c.flush()
        fields, _ = header_of(data)
        row = {"offset": offset, "length": len(member), "type": fields["warc-type"], "id": fields["warc-record-id"], "page_id": fields.get("x-page-id")}
        target.write(member)
        index.write(json.dumps(row).encode() + b"\n")
        offset += len(member)
        n += 1
    return n


def read_member(source, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Header and payload of the record at an offset of the index."""
    source.seek(offset)
    data = zlib.decompress(source.read(length), 31)
    fields, body = header_of(data)
    block = data[body : body + int(fields["content-length"])]
    return fields, block[block.index(b"\r\n\r\n") + 4 :]


def revisits(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """pages with payload, digest and first (the smallest id of equal payloads, where there are several)."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.withColumn("payload", payload).withColumn("digest", F.sha2("payload", 256))
    big = F.octet_length("payload") >= LEAST_REVISIT
    digests = pages.select(F.col(id_col).alias("id"), payload.alias("payload")).where(big).select("id", F.sha2("payload", 256).alias("digest"))
    first = digests.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    # payloads go by page and digest: pages of one payload don't meet in one task, as they would by the digest alone
    of_page = digests.distinct().join(first, "digest").select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), "first")
    return rows.join(of_page, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left").drop("__id", "__digest")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes the archives, each as one gzip stream that is normalised at once; returns the files: path, index, records."""
    rows = revisits(pages.select(id_col, url_col, payload_col), id_col, payload_col).select(F.col(id_col).cast("long"), url_col, "payload", "digest", F.col("first").cast("long"))

    def archive(store, base: str, rows: list[tuple]) -> tuple[str, str, int]:
        name = f"{base}/{uuid.uuid4().hex}"
        c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        with store.open_output_stream(f"{name}.mono.gz", compression=None) as f:
            for page_id, url, payload, digest, first in rows:
                kind = "revisit" if first is not None and page_id != first else "response"
                f.write(c.compress(record(page_id, url, payload, digest, kind, first)))
            f.write(c.flush())
        with store.open_input_stream(f"{name}.mono.gz", compression=None) as a, store.open_output_stream(f"{name}.warc.gz", compression=None) as b, store.open_output_stream(f"{name}.idx", compression=None) as c_:
            n = normalise(a, b, c_)
        store.delete_file(f"{name}.mono.gz")
        return f"{name}.warc.gz", f"{name}.idx", n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        held: list[tuple] = []
        size = 0
        done = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                size += len(row[2])
                if size >= ARCHIVE_BYTES:
                    done.append(archive(store, base, held))
                    held, size = [], 0
        if held:
            done.append(archive(store, base, held))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["path", "index", "records"])

    return settle(rows.mapInArrow(run, "path string, index string, records long"), "warc-files")


def read_back(files: DataFrame, folder: str, partitions: int) -> DataFrame:
    """Every record of the archives, by the index: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist(), strict=True):
                with store.open_input_stream(index, compression=None) as f:
                    at = [json.loads(line) for line in f.read().splitlines()]
                out = []
                size = 0
                with store.open_input_file(path) as f:
                    for k, x in enumerate(at):
                        fields, payload = read_member(f, x["offset"], x["length"])
                        digest = fields["warc-payload-digest"].removeprefix("sha256:")
                        kind = fields["warc-type"]
                        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{path}: the payload at {x['offset']} isn't what was written")
                        number = lambda name, fields=fields: int(fields[name]) if name in fields else None
                        out.append((number("x-page-id"), fields.get("warc-target-uri"), payload if kind == "response" else None, number("x-payload-length"), digest, kind, number("x-refers-to-page-id")))
                        size += len(payload)
                        if size > 4_000_000 or k == len(at) - 1:
                            kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                            out, size = [], 0

    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return files.select("path", "index").repartition(partitions).mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back: a row per page, without the payload itself."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    files = write(pages, folder)
    back = read_back(files, folder, max(8, 4 * spark.sparkContext.defaultParallelism))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages
), d AS (
  SELECT page_id, n, sha256(body) AS digest FROM p
), f AS (
  SELECT digest, min(page_id) AS first FROM d WHERE n >= {LEAST_REVISIT} GROUP BY digest HAVING count(*) > 1
)
SELECT d.page_id, d.n AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN f.first IS NOT NULL AND d.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first IS NOT NULL AND d.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.digest = f.digest AND d.n >= {LEAST_REVISIT}
"""
