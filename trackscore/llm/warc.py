"""WARC archives as a chunked record table.

Writing: a record is a header and its payload in pieces, each a small write into a gzip
member, so no copy of a record is built beside the row it comes from. A task rolls to a new
archive at ``ARCHIVE_BYTES``. Archives get names of their own per attempt; only those in
the ledger that Spark commits count, so a failed or repeated task leaves no record twice.

Reading: an archive is streamed. Each record becomes rows of one chunk (``record_id``,
``chunk_no``, ``data``) that carry the digest of the payload so far; the last chunk's is the
payload's. Neither side holds a payload longer than a chunk beyond what Spark's own row
needs, and a reader of the table sees bounded rows whatever the payload.

Equal payloads are found by length and digest: the smallest key is the response, and rows
that share it are all responses; others are written as revisits without a payload.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 256 * 1024
ARCHIVE_BYTES = 128 * 1024 * 1024
RECORD_ID = "urn:page:"
MOST_TASKS = 20_000  # that read archives; beyond it a task reads several

LEDGER = "path string, records long, bytes long"
CHUNKS = ("record_id string, record_type string, refers_to string, payload_length long, header_digest string, "
          "target_uri string, chunk_no int, last boolean, data binary, digest string")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute path."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode().rstrip("=")


def _clean(value: str) -> str:
    """A header value: line ends and other controls become spaces."""
    return "".join(c if c >= " " else " " for c in value)


class _Archive:
    """A gzip file of records, written in pieces."""

    def __init__(self, folder: str):
        self.path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.gz"
        system, path = _open(self.path)
        self.stream = system.open_output_stream(path, compression=None)
        self.records = self.size = 0

    def record(self, headers: list[tuple[str, str]], payload: pa.Buffer | None, chunk: int) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        length = payload.size if payload is not None else 0
        head = "".join(f"{k}: {_clean(v)}\r\n" for k, v in [*headers, ("Content-Length", str(length))])
        self._put(packer.compress(f"WARC/1.1\r\n{head}\r\n".encode()))
        for at in range(0, length, chunk):
            self._put(packer.compress(memoryview(payload)[at:at + chunk]))
        self._put(packer.compress(b"\r\n\r\n"))
        self._put(packer.flush())
        self.records += 1

    def _put(self, data: bytes) -> None:
        if data:
            self.stream.write(data)
            self.size += len(data)

    def close(self) -> tuple[str, int, int]:
        self.stream.close()
        return self.path, self.records, self.size


def _writer(folder: str, archive_bytes: int, chunk: int):
    def write(batches):
        archive, done = None, []
        for batch in batches:
            keys, urls = batch.column("_key").to_pylist(), batch.column("_url").to_pylist()
            first, digests = batch.column("_first").to_pylist(), batch.column("_digest").to_pylist()
            payloads = batch.column("_payload")
            for i, key in enumerate(keys):
                payload = payloads[i].as_buffer() or pa.py_buffer(b"")
                refers = first[i] is not None and first[i] != key
                headers = [("WARC-Type", "revisit" if refers else "response"),
                           ("WARC-Record-ID", f"<{RECORD_ID}{'' if key is None else key}>"),
                           ("WARC-Target-URI", urls[i] or ""),
                           ("WARC-Payload-Digest", "sha1:" + base32_sha1(bytes.fromhex(digests[i]))),
                           ("X-Payload-Length", str(payload.size)), ("Content-Type", "text/html")]
                if refers:
                    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                                ("WARC-Refers-To", f"<{RECORD_ID}{first[i]}>")]
                archive = archive or _Archive(folder)
                archive.record(headers, None if refers else payload, chunk)
                if archive.size >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()),
             pa.array([d[2] for d in done], pa.int64())], names=["path", "records", "bytes"])

    return write


def with_first(pages: DataFrame, folder: str, *, key: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """(_key, _url, _payload, _digest, _first): payload bytes, their hex SHA-1, and the smallest key that has them.

    ``_first`` is null for a payload that occurs once. The repeated payloads' digests are written below
    ``folder``, so that Spark knows their size when it joins them.
    """
    body = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("_key"), F.col(f"`{url}`").cast("string").alias("_url"),
                        body.alias("_payload"))
    rows = rows.withColumn("_digest", F.sha1("_payload"))
    # The aggregate has a row per task and payload at most, so a hot payload is no hot group there.
    firsts = (rows.select("_key", "_digest", F.octet_length("_payload").alias("_size"))
              .groupBy("_digest", "_size").agg(F.min("_key").alias("_first"), F.count(F.lit(1)).alias("_uses"))
              .where("_uses > 1").drop("_uses"))
    firsts.write.parquet(f"{folder.rstrip('/')}/firsts")
    firsts = pages.sparkSession.read.schema(firsts.schema).parquet(f"{folder.rstrip('/')}/firsts")
    return (rows.withColumn("_size", F.octet_length("_payload")).join(firsts, ["_digest", "_size"], "left")
            .select("_key", "_url", "_payload", "_digest", "_first"))


def write_archives(pages: DataFrame, folder: str, *, key: str = "page_id", payload: str = "html", url: str = "url",
                   archive_bytes: int = ARCHIVE_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write a record per row below ``folder``, a place all executors reach; returns the ledger (path, records, bytes).

    The ledger is itself written below ``folder`` by Spark and read back: its commit decides
    which archives count. A null payload is empty, a null url an empty header. A null key
    gives a record id without a number; such rows are never a first unless all rows of the
    payload are such, and then all are responses.
    """
    spark = pages.sparkSession
    system, path = _open(f"{folder.rstrip('/')}/archives")
    system.create_dir(path, recursive=True)
    written = with_first(pages, folder, key=key, payload=payload, url=url).mapInArrow(
        _writer(f"{folder.rstrip('/')}/archives", archive_bytes, chunk_bytes), LEDGER)
    written.write.parquet(f"{folder.rstrip('/')}/ledger")
    return spark.read.schema(LEDGER).parquet(f"{folder.rstrip('/')}/ledger")


def _fill(stream, size: int) -> bytes:
    data = stream.read(size)
    while len(data) < size:
        more = stream.read(size - len(data))
        if not more:
            break
        data += more
    return data


def _member_stream(raw) -> io.BufferedReader:
    """A gzip stream of many members, decompressed as it is read."""
    import gzip

    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16)


def records_of(stream, chunk: int) -> Iterator[dict]:
    """Chunk rows of an uncompressed WARC stream."""
    while True:
        version = stream.readline()
        if not version:
            return
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should start: {version[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.lower()] = value.strip()
        left, number, digest = int(headers["content-length"]), 0, hashlib.sha1()
        about = {
            "record_id": headers["warc-record-id"].strip("<>"), "record_type": headers["warc-type"],
            "refers_to": headers.get("warc-refers-to", "").strip("<>") or None,
            "payload_length": int(headers.get("x-payload-length", headers["content-length"])),
            "header_digest": headers.get("warc-payload-digest", "").removeprefix("sha1:"),
            "target_uri": headers.get("warc-target-uri", ""),
        }
        while True:
            data = _fill(stream, min(chunk, left))
            if len(data) < min(chunk, left):
                raise ValueError(f"{about['record_id']} ends early")
            left -= len(data)
            digest.update(data)
            yield {**about, "chunk_no": number, "last": left == 0, "data": data, "digest": base32_sha1(digest.copy().digest())}
            number += 1
            if not left:
                break
        if _fill(stream, 4) != b"\r\n\r\n":
            raise ValueError(f"{about['record_id']} is longer than it says")


def _reader(chunk: int):
    kinds = [("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_length", pa.int64()),
             ("header_digest", pa.string()), ("target_uri", pa.string()), ("chunk_no", pa.int32()), ("last", pa.bool_()),
             ("data", pa.binary()), ("digest", pa.string())]
    schema = pa.schema(kinds)

    def read(batches):
        rows, held = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, inner = _open(path)
                with system.open_input_stream(inner, compression=None) as raw:
                    for row in records_of(_member_stream(raw), chunk):
                        rows.append(row)
                        held += len(row["data"])
                        if held >= 8 * chunk or len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return read


def read_chunks(ledger: DataFrame, *, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of the ledger's archives: at least one row per record.

    Chunks are numbered from 0 in payload order; ``digest`` covers the payload up to and with
    the chunk, ``last`` marks the last. A revisit has one empty chunk. A damaged archive
    fails the read. An empty ledger gives an empty table.
    """
    files = ledger.select("path").where(F.col("path").isNotNull())
    spread = files.repartition(min(MOST_TASKS, max(1, files.count())), "path")
    return spread.mapInArrow(_reader(chunk_bytes), CHUNKS)


def record_table(chunks: DataFrame, prefix: str = RECORD_ID) -> DataFrame:
    """One row per record: key, type, refers_to (keys), payload_bytes, payload_digest, n_chunks, intact.

    Only a record's last chunk is needed: its incremental digest is that of the payload, so
    nothing is gathered or joined. ``intact`` says that a response's content has the length
    and digest that its header announced.
    """
    def key(c: str):
        return F.expr(f"nullif(substring({c}, {len(prefix) + 1}), '')").cast("long")

    revisit = F.col("record_type") == "revisit"
    return chunks.where("last").select(
        key("record_id").alias("key"), "record_type", key("refers_to").alias("refers_to"),
        F.col("payload_length").alias("payload_bytes"),
        F.when(revisit, F.col("header_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        (F.col("chunk_no") + 1).alias("n_chunks"), (revisit | (F.col("digest") == F.col("header_digest"))).alias("intact"))
