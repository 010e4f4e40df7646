"""Revisit resolution: WARC archives in which equal payloads are kept once.

1. Headers only (row key, digest, byte count) are summed by payload digest; the smallest
   id of a digest that occurs more than once is its response. A digest may hold a third
   of all rows: it is combined inside each task first.
2. Pages meet their digest's response by a salted join on the digest.
3. Each task streams its records into one gzip archive (a member for each record) in a
   folder that all executors share, with fresh headers: new block and payload digests,
   content lengths and, for revisits, what they refer to. File names depend on the
   partition only and appear by a rename, so a lost task is simply run again.
4. Archives are read back as streams, record by record, and payload digests are checked.

Null html is an empty payload. Payloads below ``least_bytes`` are always responses. Rows
that repeat the response's id are responses too; a null id comes last and is written
without the id header. A null url is written without target. Empty table: no archive, no
rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import as_bytes, scratch_path, slices

LEAST_BYTES = 100
SALTS = 16
DATE = "2024-01-01T00:00:00Z"
ARCHIVE_SCHEMA = "path string, records long, bytes long"
RECORD_SCHEMA = ("record_type string, record_id string, page_id long, url string, date string, payload_bytes long, payload_digest string, "
                 "refers_to long, refers_to_record string, digest_valid boolean")


def resolve(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = LEAST_BYTES, salts: int = SALTS) -> DataFrame:
    """Pages as (page_id, url, payload, payload_digest, refers_to, refers_to_url); refers_to is null for responses."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload")).withColumn(
        "payload_digest", F.sha2("payload", 256))
    first = (rows.filter(F.octet_length("payload") >= least_bytes)
             .groupBy("payload_digest").agg(F.count("*").alias("n"), F.min(F.struct("page_id", "url")).alias("a"),
                                            F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("b"))
             .filter("n > 1").select("payload_digest", F.coalesce("b", "a").alias("first")))
    copies = first.select("payload_digest", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    revisit = F.col("first").isNotNull() & F.col("first.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return (salted.join(copies, ["payload_digest", "salt"], "left")
            .select("page_id", "url", "payload", "payload_digest",
                    F.when(revisit, F.col("first.page_id")).alias("refers_to"), F.when(revisit, F.col("first.url")).alias("refers_to_url")))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _uri(url: bytes) -> bytes:
    """Bytes that would end or break a header line are percent-encoded."""
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url)


def record(page_id: int | None, url: bytes, payload: bytes, digest: str, refers_to: int | None, refers_to_url: bytes, date: str) -> bytes:
    """One WARC 1.1 record. A revisit carries the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + record_id(page_id, digest).encode(),
             b"WARC-Date: " + date.encode(), b"WARC-Payload-Digest: sha256:" + digest.encode(),
             b"WARC-Block-Digest: sha256:" + hashlib.sha256(block).hexdigest().encode(), b"Content-Type: application/http; msgtype=response"]
    if url:
        lines.append(b"WARC-Target-URI: " + _uri(url))
    if page_id is not None:
        lines.append(b"X-Page-Id: %d" % page_id)
    if revisit:
        lines += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  b"WARC-Refers-To: " + record_id(refers_to, digest).encode(), b"WARC-Refers-To-Date: " + date.encode(), b"X-Refers-To-Page-Id: %d" % refers_to]
        if refers_to_url:
            lines.append(b"WARC-Refers-To-Target-URI: " + _uri(refers_to_url))
    lines.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def open_store(path: str):
    """The file system of a shared folder and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_archives(resolved: DataFrame, folder: str, date: str = DATE) -> DataFrame:
    """Write the records and give (path, records, bytes) of each archive; runs when the result is used."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        context = TaskContext.get()
        name = f"{base}/part-{context.partitionId():06d}.warc.gz"
        partial = f"{name}.{context.taskAttemptId()}"
        records = size = 0
        with store.open_output_stream(partial, compression=None) as out:
            for batch in slices(batches, "payload"):
                ids, refers = batch.column("page_id").to_pylist(), batch.column("refers_to").to_pylist()
                digests = batch.column("payload_digest").to_pylist()
                for i, url, body, digest, to, to_url in zip(ids, as_bytes(batch, "url"), as_bytes(batch, "payload"), digests, refers,
                                                            as_bytes(batch, "refers_to_url"), strict=True):
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    member = packer.compress(record(i, url, body, digest, to, to_url, date)) + packer.flush()
                    out.write(member)
                    records, size = records + 1, size + len(member)
        if records:
            store.move(partial, name)
            yield pa.record_batch({"path": pa.array([f"{folder}/{os.path.basename(name)}"]), "records": pa.array([records], pa.int64()), "bytes": pa.array([size], pa.int64())})
        else:
            store.delete_file(partial)

    return resolved.mapInArrow(write, ARCHIVE_SCHEMA)


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time."""
    held, packer, parts = b"", zlib.decompressobj(31), []
    while True:
        if not held:
            held = stream.read(chunk)
            if not held:
                if parts:
                    raise ValueError("archive ends inside a record")
                return
        parts.append(packer.decompress(held))
        held = packer.unused_data
        if packer.eof:
            yield b"".join(parts)
            packer, parts = zlib.decompressobj(31), []


def parsed(member: bytes) -> tuple:
    """A record's columns as in RECORD_SCHEMA; the digest is recomputed where there is a payload."""
    head, _, rest = member.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.decode().lower(): v.strip() for k, v in (line.split(b":", 1) for line in lines)}
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["warc-type"].decode(), fields["warc-payload-digest"].decode().removeprefix("sha256:")
    length = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)[1])
    valid = hashlib.sha256(block).hexdigest() == fields["warc-block-digest"].decode().removeprefix("sha256:")
    if kind == "response":
        valid &= len(payload) == length and hashlib.sha256(payload).hexdigest() == digest

    def text(name: str) -> str | None:
        return fields[name].decode("utf-8", "replace") if name in fields else None

    def number(name: str) -> int | None:
        return int(fields[name]) if name in fields else None

    return (kind, text("warc-record-id"), number("x-page-id"), text("warc-target-uri"), text("warc-date"), length, digest,
            number("x-refers-to-page-id"), text("warc-refers-to"), valid)


def read_archives(archives: DataFrame, path: str = "path") -> DataFrame:
    """The records (without payloads) of the archives in column ``path``; one archive is one stream."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(RECORD_SCHEMA))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                store, inner = open_store(name)
                rows = []
                with store.open_input_stream(inner, compression=None) as stream:
                    for member in members(stream):
                        rows.append(parsed(member))
                        if len(rows) == 4096:
                            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return archives.select(F.col(path).alias("path")).mapInArrow(read, RECORD_SCHEMA)


def write_and_read(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Resolve, write to ``folder`` (a new shared one unless given) and read back."""
    spark: SparkSession = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    archives = write_archives(resolve(pages, **options), folder).collect()  # a row for each archive: its path and sizes
    listed = spark.createDataFrame([tuple(row) for row in archives], ARCHIVE_SCHEMA)
    return read_archives(listed.repartition(max(1, len(archives)), "path"))
