"""Substring dedup on token windows.

Every window of ``width`` consecutive words gets a Rabin-Karp hash. Spark counts them:
chunks of documents send their distinct hashes, with the smallest document id of each,
to buckets of the hash range; a bucket finds the first document of every hash and tells
each chunk, bit by bit, which of its hashes start in an earlier document elsewhere.
Windows so repeated merge into maximal intervals, which are cut from the text.

A hot passage costs each chunk one entry, however many documents hold it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed

WIDTH = 13

SENT = "bucket int, chunk long, prints binary, owners binary"
TOLD = "_chunk long, bucket int, earlier binary"
SPANS = "array<struct<start:long,stop:long>>"
SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


class _Chunk:
    """Words and window hashes of a chunk of documents."""

    def __init__(self, table: pa.Table, width: int):
        table = packed.in_order(table)
        self.carried = table.select([c for c in table.column_names if c.startswith("_carry")])
        self.ids = table.column("_id").to_numpy()
        self.null = table.column("_text").is_null().to_numpy(zero_copy_only=False)
        self.data, self.offsets = packed.utf8_column(table.column("_text"))
        self.words = packed.Words(self.data, self.offsets)
        prints = packed.mixed(packed.rolling(self.words.hash, width))
        doc = self.words.doc
        self.starts = np.flatnonzero(doc[:len(prints)] == doc[width - 1:]) if len(prints) else np.zeros(0, np.int64)
        self.prints = prints[self.starts]
        self.owners = self.ids[doc[self.starts]]
        self.distinct, self.first = packed.first_owners(self.prints, self.owners)


def _send(width: int, buckets: int):
    def send(table: pa.Table) -> pa.Table:
        packed.release()
        chunk = _Chunk(table, width)
        edges = packed.bucket_edges(chunk.distinct, buckets)
        full = [b for b in range(buckets) if edges[b] < edges[b + 1]]
        return pa.table({
            "bucket": pa.array(full, pa.int32()),
            "chunk": pa.array([table.column("_chunk")[0].as_py()] * len(full), pa.int64()),
            "prints": pa.array([packed.to_planes(chunk.distinct[edges[b]:edges[b + 1]]) for b in full], pa.binary()),
            "owners": pa.array([packed.plain_planes(chunk.first[edges[b]:edges[b + 1]]) for b in full], pa.binary()),
        })

    return send


def _tell(table: pa.Table) -> pa.Table:
    """For each chunk of a bucket: which of its hashes have a smaller first document elsewhere."""
    prints = [packed.from_planes(x) for x in table.column("prints").to_pylist()]
    owners = [packed.from_plain_planes(x) for x in table.column("owners").to_pylist()]
    sizes = np.cumsum([0, *map(len, prints)])
    every, owner = np.concatenate(prints), np.concatenate(owners)
    del prints, owners
    order = np.argsort(every)
    run = every[order]
    starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    ranked = owner[order]
    least = np.repeat(np.minimum.reduceat(ranked, starts), np.diff(np.append(starts, len(run))))
    earlier = np.empty(len(every), bool)
    earlier[order] = least < ranked
    return pa.table({
        "_chunk": table.column("chunk"),
        "bucket": table.column("bucket"),
        "earlier": pa.array([np.packbits(earlier[a:b]).tobytes() for a, b in zip(sizes, sizes[1:])], pa.binary()),
    })


def covered(starts: np.ndarray, width: int, total: int) -> np.ndarray:
    """Which of ``total`` positions lie in a window of ``width`` that starts at one of ``starts``."""
    change = np.zeros(total + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + width, total), -1)
    return np.cumsum(change[:-1]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the maximal runs of True."""
    step = np.diff(flags.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _cut(width: int, buckets: int):
    def cut(docs: pa.Table, told: pa.Table) -> pa.Table:
        packed.release()
        chunk = _Chunk(docs, width)
        edges = packed.bucket_edges(chunk.distinct, buckets)
        earlier = np.zeros(len(chunk.distinct), bool)
        for b, bits in zip(told.column("bucket").to_pylist(), told.column("earlier").to_pylist()):
            a, z = edges[b], edges[b + 1]
            earlier[a:z] = np.unpackbits(np.frombuffer(bits, np.uint8), count=z - a).astype(bool)
        where = np.searchsorted(chunk.distinct, chunk.prints)
        repeated = earlier[where] | (chunk.first[where] < chunk.owners) if len(where) else np.zeros(0, bool)
        words = chunk.words
        gone = covered(chunk.starts[repeated], width, len(words.starts))
        lost = np.zeros(len(gone) + 1, np.int64)
        np.cumsum(gone, out=lost[1:])
        texts, spans = [], []
        for d in range(len(chunk.ids)):
            a, z = words.first[d], words.first[d + 1]
            begin, end = chunk.offsets[d], chunk.offsets[d + 1]
            if chunk.null[d] or lost[z] == lost[a]:
                texts.append(None if chunk.null[d] else chunk.data[begin:end].tobytes())
                spans.append([])
                continue
            # Cut from the start of a removed run to the start of the next kept word.
            left, right = runs(gone[a:z])
            parts, at = [], begin
            for i, j in zip(left, right):
                parts.append(chunk.data[at:words.starts[a + i]].tobytes())
                at = words.starts[a + j] if a + j < z else end
            parts.append(chunk.data[at:end].tobytes())
            texts.append(b"".join(parts))
            spans.append([{"start": int(i), "stop": int(j)} for i, j in zip(left, right)])
        return pa.table({
            "_id": pa.array(chunk.ids, pa.int64()),
            **dict(zip(chunk.carried.column_names, chunk.carried.columns)),
            "_text": pa.array(texts, pa.binary()).cast(pa.string()),
            "n_words": pa.array(np.diff(words.first), pa.int64()),
            "n_removed": pa.array(lost[words.first[1:]] - lost[words.first[:-1]], pa.int64()),
            "spans": pa.array(spans, SPANS_ARROW),
        })

    return cut


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = WIDTH,
                   carry: Sequence[str] = (), chunk_bytes: int = packed.CHUNK_BYTES,
                   bucket_prints: int = packed.BUCKET_PRINTS) -> DataFrame:
    """(key, text, n_words, n_removed, spans, carried columns): texts without words that an earlier document has.

    A word goes if a window of ``width`` words that covers it also starts in a document
    with a smaller key; windows are judged on the input. ``spans`` are the removed word
    intervals [start, stop). What is left keeps its own white space; a text that loses
    nothing is unchanged.

    A null text has no words and stays null. Texts of fewer words than a window keep all.
    Rows that repeat a key count as one document: none removes from another, all give way
    to smaller keys. Rows with a null key are not compared: they come back whole, with
    n_removed 0. Columns named in ``carry`` come back with their rows, others are not used.
    An empty table gives an empty result.
    """
    rows, size = packed.dealt(docs, key, text, chunk_bytes, carry)
    buckets = packed.pieces(size // 5, bucket_prints)  # about five bytes to a word, at the least
    sent = rows.groupBy("_chunk").applyInArrow(_send(width, buckets), SENT)
    told = sent.groupBy("bucket").applyInArrow(_tell, TOLD)
    kinds = "".join(f"_carry{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(carry))
    cut = rows.groupBy("_chunk").cogroup(told.groupBy("_chunk")).applyInArrow(
        _cut(width, buckets), f"_id long, {kinds}_text string, n_words long, n_removed long, spans {SPANS}")
    body = F.col(f"`{text}`").cast("string")
    words = F.filter(F.split(F.coalesce(body, F.lit("")), "[ \t-\r]+", -1), lambda w: w != "")
    whole = docs.where(F.col(f"`{key}`").isNull()).select(
        F.col(f"`{key}`").cast("long").alias("_id"), *packed.carried(carry), body.alias("_text"),
        F.size(words).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"),
        F.array().cast(SPANS).alias("spans"))
    both = cut.unionByName(whole)
    return both.select(F.col("_id").alias(key), F.col("_text").alias(text), "n_words", "n_removed", "spans",
                       *(F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)))
