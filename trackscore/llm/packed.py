"""Helpers for operators that fingerprint every position of every text.

One row per position would make the shuffle many times the text. Here texts are dealt
into chunks by a hash of their id; a chunk sends each bucket (a range of the 64-bit
fingerprints) one row with its distinct fingerprints in ascending order, as differences
in byte planes, which the shuffle's codec shrinks well. As chunks and buckets multiply
with the data, rows get shorter and at the far end hold one fingerprint each.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 4_000_000
BUCKET_PRINTS = 1_000_000
#: Bytes that separate words: space and the five controls from tab to carriage return.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[list(SEPARATORS)] = True
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


BATCH_ROWS = 2000
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let tasks get texts by ``BATCH_ROWS`` and ``BATCH_BYTES`` at most: Spark's defaults hold tens of MB on both sides.

    The settings are read when a plan runs, so they stay with the session.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
                       ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def release(collect: bool = True) -> None:
    """Hand freed memory back to the system: Spark keeps a Python worker for its next task."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(docs: DataFrame, text: str) -> tuple[int, int]:
    """(rows, bytes of UTF-8) of a table."""
    row = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(f"`{text}`")))).first()
    return row[0], row[1] or 0


def pieces(total: int, each: int) -> int:
    return max(1, math.ceil(total / each))


def utf8_column(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    array = array.cast(pa.large_string()).fill_null("")
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset:array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    buffer = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buffer[offsets[0]:offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a batch of texts: byte spans, document of each, and a 64-bit hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        if lower:
            data = np.where((data >= 65) & (data <= 90), data | 0x20, data)
        inside = ~IS_SEPARATOR[data]
        edge = np.empty(len(data) + 1, bool)  # True where a word starts or a word has ended
        edge[0] = len(data) > 0 and inside[0]
        edge[-1] = len(data) > 0 and inside[-1]
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        ends_doc = offsets[1:-1]
        cut = ends_doc[(ends_doc > 0) & (ends_doc < len(data))]
        joined = np.unique(cut[inside[cut] & inside[cut - 1]])  # a text that ends in a word, before one that starts with one
        starts = np.flatnonzero(edge[:-1] & inside) if len(data) else np.zeros(0, np.int64)
        stops = np.flatnonzero(edge[1:] & inside) + 1 if len(data) else np.zeros(0, np.int64)
        if len(joined):
            starts = np.sort(np.concatenate([starts, joined]))
            stops = np.sort(np.concatenate([stops, joined]))
        self.starts, self.stops = starts, stops
        self.first = np.searchsorted(starts, offsets)  # first word of each document, and the total
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        sizes = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(stops - starts, out=sizes[1:])
        solid = data[inside]
        if len(starts):
            flat = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(sizes), pa.py_buffer(solid)])
            coded = flat.dictionary_encode()
            own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64,
                              len(coded.dictionary))
            self.codes, self.vocabulary = coded.indices.to_numpy(), coded.dictionary
            self.hash = own[self.codes]
        else:
            self.codes, self.vocabulary, self.hash = np.zeros(0, np.int64), pa.array([], pa.large_binary()), np.zeros(0, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes; different inputs stay different."""
    h = h ^ (h >> np.uint64(30))
    h = h * MIX[0]
    h ^= h >> np.uint64(27)
    h *= MIX[1]
    h ^= h >> np.uint64(31)
    return h


def rolling(items: np.ndarray, width: int, base: np.uint64 = ODD) -> np.ndarray:
    """Rabin-Karp hash (modulo 2**64) of every ``width`` consecutive items.

    Built by doubling: the hash of m + n items is that of the first m times base**n plus
    that of the next n.
    """
    count = len(items) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out, done = None, 0
    power, size, weight = items, 1, base
    left = width
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if out is None:
                    out = power
                else:
                    n = min(len(out), len(power) - done)
                    out = out[:n] * weight + power[done:done + n]
                done += size
            left >>= 1
            if left:
                power = power[:len(power) - size] * weight + power[size:]
                weight, size = weight * weight, size * 2
    return out[:count]


def to_planes(values: np.ndarray) -> bytes:
    """Ascending unsigned integers as byte planes of their differences."""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1)
    return np.cumsum(steps, dtype=np.uint64)


def plain_planes(values: np.ndarray) -> bytes:
    """Integers in any order as byte planes."""
    return np.ascontiguousarray(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()


def from_plain_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.int64).reshape(-1)


def bucket_edges(sorted_prints: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket starts among ascending fingerprints; ``buckets + 1`` entries."""
    bounds = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_prints, bounds), [len(sorted_prints)]])


def unused(frame: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``frame`` has it (in any case)."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def carried(columns: Sequence[str]) -> list[Column]:
    """Columns that travel with a text, under names that clash with nothing."""
    return [F.col(f"`{c}`").alias(f"_carry{i}") for i, c in enumerate(columns)]


def dealt(docs: DataFrame, key: str, text: str, chunk_bytes: int = CHUNK_BYTES,
          carry: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """Rows with a key as (_chunk, _id, _text, carried columns), and their bytes; the chunk is a hash of the key."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"),
                       *carried(carry))
    rows = rows.where(F.col("_id").isNotNull())
    _, size = text_bytes(rows, "_text")
    chunks = pieces(size, chunk_bytes)
    return rows.withColumn("_chunk", F.pmod(F.xxhash64("_id"), F.lit(chunks))), size


def in_order(table: pa.Table) -> pa.Table:
    """A chunk's rows in an order that does not depend on how they arrived."""
    return table.sort_by([("_id", "ascending"), ("_text", "ascending")])


def first_owners(prints: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct prints, ascending, and the smallest owner of each."""
    if not len(prints):
        return prints, owners
    order = np.argsort(prints)
    prints, owners = prints[order], owners[order]
    starts = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
    return prints[starts], np.minimum.reduceat(owners, starts)
