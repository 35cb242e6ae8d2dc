"""WARC round trips."""

import base64
import gzip
import hashlib
import io

import pytest

from trackscore.llm import warc


def pages(spark):
    rows = [(i, f"http://a/{i}", f"<p>{'é' * (i % 4)} {i // 3}</p>") for i in range(30)]
    rows += [(100, None, None), (101, "u", ""), (102, "u", "\r\nWARC/1.1\r\n\r\n"), (103, "bad\r\nX: y", "x" * 700_000),
             (104, "u", "x" * 700_000), (None, "u", "alone"), (None, "u", "x" * 700_000), (5, "again", "<p>é 1</p>"), (105, "u", "\0")]
    full = [(i, u, h, "t", 1) for i, u, h in rows]
    return rows, spark.createDataFrame(full, "page_id long, url string, html string, digest string, _key int").repartition(3)


def want(rows):
    first = {}
    for i, _, h in rows:
        body = (h or "").encode()
        if i is not None:
            first[body] = min(i, first.get(body, i))
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        kind = "response" if first.get(body, i) == i else "revisit"
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((i, len(body), digest, kind, None if kind == "response" else first[body]))
    return sorted(out, key=repr)


def test_round_trip(spark, tmp_path):
    rows, table = pages(spark)
    ledger = warc.write_archives(table, f"file://{tmp_path}/w", archive_bytes=2_000)
    assert ledger.count() > 3  # archives roll
    chunks = warc.read_chunks(ledger, chunk_bytes=10_000).cache()
    got = warc.record_table(chunks).collect()
    assert all(r.intact for r in got)
    assert sorted([(r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=repr) == want(rows)
    assert max(r.n_chunks for r in got) == 70
    parts = chunks.where("record_id = 'urn:page:103'").orderBy("chunk_no").collect()
    body = b""
    for r in parts:  # digests grow with the payload
        assert len(r.data) <= 10_000
        body += bytes(r.data)
        assert r.digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
    assert body == b"x" * 700_000


def test_archives_are_plain_gzip(spark, tmp_path):
    _, table = pages(spark)
    ledger = warc.write_archives(table.where("page_id < 3"), f"{tmp_path}/w").collect()
    text = b"".join(gzip.open(r.path).read() for r in ledger if r.path).decode()
    assert text.count("WARC/1.1\r\n") == 3 and text.count("WARC-Type: response") == 3


def test_empty_table_and_damage(spark, tmp_path):
    _, table = pages(spark)
    ledger = warc.write_archives(table.where("false"), f"file://{tmp_path}/none")
    assert warc.record_table(warc.read_chunks(ledger)).collect() == []
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 5\r\n\r\nabc"
    with pytest.raises(ValueError, match="ends early"):
        list(warc.records_of(io.BytesIO(record), 100))
    with pytest.raises(ValueError, match="longer than it says"):
        list(warc.records_of(io.BytesIO(record + b"def\r\n\r\n"), 100))
