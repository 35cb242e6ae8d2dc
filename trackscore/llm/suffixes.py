"""Exact substring dedup with a logarithmic family of sparse suffix arrays.

A repeated string of ``LENGTH`` bytes holds, at the same place in all its copies, the
``ANCHOR``-byte string whose hash is smallest among those inside it. Only suffixes at such
anchors need indexing, about one in fourteen; and of those only the ones whose anchor
occurs more than once. The work has three passes over chunks of documents:

1. Chunks send the hashes of their anchors to buckets of the hash range, which answer which
   of them are shared.
2. Chunks send each shared anchor with the bytes around it that a window of ``LENGTH`` bytes
   can reach. A bucket takes these contexts in the order of their documents, batch by batch.
   A batch gets its suffix array: the windows of its contexts in lexicographic order. It is
   merge-scanned against the arrays of all levels, which hold earlier documents, and then
   becomes a level itself; levels of equal size merge, so there are logarithmically many.
   The bucket answers which windows of each context start in an earlier document.
3. Chunks turn the answers into maximal byte runs and cut them.

Contexts are compared byte for byte; hashes only decide where they meet. A context that
many documents of a chunk share is sent once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .windows import SPANS, SPANS_ARROW, covered, runs

LENGTH = 50
ANCHOR = 24
BATCHES = 8  # of a bucket's contexts, by document order
BUCKET_CONTEXTS = 30_000
CHUNK_BYTES = 2_000_000

ANCHORS = "bucket int, chunk long, prints binary, several binary"
CONTEXTS = "bucket int, chunk long, prints binary, bytes binary, bounds binary, owners binary"
TOLD = "_chunk long, kind int, bucket int, answer binary"


def spread_minimum(values: np.ndarray, width: int, largest: bool = False) -> np.ndarray:
    """Minimum (or maximum) of every ``width`` consecutive values, by doubling."""
    pick = np.maximum if largest else np.minimum
    out, size = values, 1
    while size * 2 <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return pick(out[:len(out) - rest], out[rest:]) if rest else out


class _Anchors:
    """Anchor positions of a chunk's texts, their hashes, and the documents they lie in."""

    def __init__(self, table: pa.Table, length: int, anchor: int):
        table = packed.in_order(table)
        self.carried = table.select([c for c in table.column_names if c.startswith("_carry")])
        self.ids = table.column("_id").to_numpy()
        self.null = table.column("_text").is_null().to_numpy(zero_copy_only=False)
        self.data, self.offsets = packed.utf8_column(table.column("_text"))
        of_byte = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.offsets))
        h = packed.mixed(packed.rolling(self.data.astype(np.uint64) + np.uint64(1), anchor))
        windows = len(self.data) - length + 1
        if windows > 0:
            inner = length - anchor + 1  # anchors in a window
            least = spread_minimum(h, inner)[:windows]
            least[of_byte[:windows] != of_byte[length - 1:]] = 0  # a window across texts has none
            # A position is an anchor if some window has its minimum there.
            edge = np.zeros(inner - 1, np.uint64)
            self.at = np.flatnonzero(h == spread_minimum(np.concatenate([edge, least, edge]), inner, largest=True))
            self.least = least
        else:
            self.at, self.least = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self.height = h[self.at]
        # Anchors have small hashes; mixed once more they spread evenly over the buckets.
        with np.errstate(over="ignore"):
            self.prints, self.docs = packed.mixed(h[self.at] + packed.ODD), of_byte[self.at]
        self.distinct, self.where, counts = np.unique(self.prints, return_inverse=True, return_counts=True)
        self.several = counts > 1

    def shared(self, answers: dict[int, bytes], buckets: int) -> np.ndarray:
        """Which anchors (positions) have a hash that occurs more than once anywhere."""
        flags = np.zeros(len(self.distinct), bool)
        edges = packed.bucket_edges(self.distinct, buckets)
        for b, bits in answers.items():
            flags[edges[b]:edges[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=edges[b + 1] - edges[b])
        return flags[self.where]

    def contexts(self, keep: np.ndarray, length: int, anchor: int):
        """Distinct contexts of the kept anchors in a fixed order.

        Returns (hash, bytes, bounds, owner, position -> context). A context has the
        ``length - anchor`` bytes before the anchor and ``length`` from it; what lies beyond
        the text is zero. ``bounds`` says at which of its windows, from and to, the anchor is
        the minimum: a window is compared there and nowhere else. That depends on the window's
        bytes alone, so equal windows are compared at the same place of equal anchors.
        """
        reach = length - anchor
        at, docs, prints = self.at[keep], self.docs[keep], self.prints[keep]
        begin, end = self.offsets[docs], self.offsets[docs + 1]
        left, right = np.minimum(at - begin, reach), np.minimum(end - at, length)
        place = at.astype(np.int32)[:, None] + np.arange(-reach, length, dtype=np.int32)
        outside = (place < (at - left)[:, None]) | (place >= (at + right)[:, None])
        body = self.data[np.clip(place, 0, max(0, len(self.data) - 1), out=place)] if len(at) else np.zeros(place.shape, np.uint8)
        body[outside] = 0
        del place, outside
        rows = np.concatenate([prints.astype(">u8").view(np.uint8).reshape(-1, 8),
                               left.astype(np.uint8)[:, None], right.astype(np.uint8)[:, None], body], axis=1)
        # Equal contexts have equal hashes, so they meet after sorting by a hash of the row.
        key = prints.copy()
        with np.errstate(over="ignore"):
            for i in range(0, body.shape[1] - 7, 4):
                key = packed.mixed(key * packed.ODD + np.ascontiguousarray(body[:, i:i + 8]).view(np.uint64).ravel())
            key = packed.mixed(key * packed.ODD + left.astype(np.uint64) * np.uint64(256) + right.astype(np.uint64))
        order = np.lexsort((key, prints))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (rows[order[1:]] != rows[order[:-1]]).any(axis=1)
        context = np.cumsum(fresh) - 1
        of = np.empty(len(order), np.int64)
        of[order] = context
        first = order[fresh]
        owner = np.minimum.reduceat(self.ids[docs[order]], np.flatnonzero(fresh)) if len(order) else np.zeros(0, np.int64)
        start = at[first][:, None] - reach + np.arange(reach + 1)
        inside = (start >= 0) & (start < len(self.least))
        lowest = self.least[np.clip(start, 0, max(0, len(self.least) - 1))] == self.height[keep][first][:, None] if len(at) else inside
        mine = inside & lowest
        begin = mine.argmax(axis=1) if len(first) else np.zeros(0, np.int64)
        bounds = np.stack([begin, begin + mine.sum(axis=1)], axis=1).astype(np.uint8)
        return prints[first], body[first], bounds, owner, of, at, docs


def _send_anchors(length: int, anchor: int, buckets: int):
    def send(table: pa.Table) -> pa.Table:
        packed.release()
        own = _Anchors(table, length, anchor)
        edges = packed.bucket_edges(own.distinct, buckets)
        full = [b for b in range(buckets) if edges[b] < edges[b + 1]]
        return pa.table({
            "bucket": pa.array(full, pa.int32()),
            "chunk": pa.array([table.column("_chunk")[0].as_py()] * len(full), pa.int64()),
            "prints": pa.array([packed.to_planes(own.distinct[edges[b]:edges[b + 1]]) for b in full], pa.binary()),
            "several": pa.array([np.packbits(own.several[edges[b]:edges[b + 1]]).tobytes() for b in full], pa.binary()),
        })

    return send


def _tell_shared(table: pa.Table) -> pa.Table:
    prints = [packed.from_planes(x) for x in table.column("prints").to_pylist()]
    sizes = np.cumsum([0, *map(len, prints)])
    several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)).astype(bool)
                              for x, p in zip(table.column("several").to_pylist(), prints)])
    every = np.concatenate(prints)
    order = np.argsort(every)
    run = every[order]
    same = run[1:] == run[:-1]
    shared = several[order]
    shared[1:] |= same
    shared[:-1] |= same
    back = np.empty(len(every), bool)
    back[order] = shared
    return pa.table({
        "_chunk": table.column("chunk"),
        "kind": pa.array([0] * table.num_rows, pa.int32()),
        "bucket": table.column("bucket"),
        "answer": pa.array([np.packbits(back[a:b]).tobytes() for a, b in zip(sizes, sizes[1:])], pa.binary()),
    })


def _answers(told: pa.Table, kind: int) -> dict[int, bytes]:
    rows = zip(told.column("kind").to_pylist(), told.column("bucket").to_pylist(), told.column("answer").to_pylist())
    return {b: x for k, b, x in rows if k == kind}


def _send_contexts(length: int, anchor: int, buckets: int, context_buckets: int):
    def send(docs: pa.Table, told: pa.Table) -> pa.Table:
        own = _Anchors(docs, length, anchor)
        keep = own.shared(_answers(told, 0), buckets)
        prints, body, bounds, owner, *_ = own.contexts(keep, length, anchor)
        edges = packed.bucket_edges(prints, context_buckets)
        full = [b for b in range(context_buckets) if edges[b] < edges[b + 1]]
        cut = [slice(edges[b], edges[b + 1]) for b in full]
        return pa.table({
            "bucket": pa.array(full, pa.int32()),
            "chunk": pa.array([docs.column("_chunk")[0].as_py()] * len(full), pa.int64()),
            "prints": pa.array([packed.to_planes(prints[c]) for c in cut], pa.binary()),
            "bytes": pa.array([body[c].tobytes() for c in cut], pa.binary()),
            "bounds": pa.array([bounds[c].tobytes() for c in cut], pa.binary()),
            "owners": pa.array([packed.plain_planes(owner[c]) for c in cut], pa.binary()),
        })

    return send


class SuffixLevels:
    """Suffix arrays of sizes that at least double from one level to the next.

    A level is a pair of arrays: strings in lexicographic order, each once, and the
    smallest document that has it. Batches must come in document order.
    """

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def scan(self, strings: np.ndarray) -> np.ndarray:
        """Smallest document of each of the ascending ``strings``; the largest integer if none."""
        found = np.full(len(strings), np.iinfo(np.int64).max)
        for known, owners in self.levels:
            at = np.minimum(np.searchsorted(known, strings), len(known) - 1)
            hit = known[at] == strings
            found[hit] = np.minimum(found[hit], owners[at[hit]])
        return found

    def add(self, strings: np.ndarray, owners: np.ndarray) -> None:
        """A new level of ascending distinct strings; levels of its size or less merge into it."""
        while self.levels and len(self.levels[-1][0]) <= 2 * len(strings):
            more, theirs = self.levels.pop()
            strings, owners = _merged(np.concatenate([more, strings]), np.concatenate([theirs, owners]))
        self.levels.append((strings, owners))


def _merged(strings: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(strings, kind="stable")  # a merge: it finds the ascending runs
    strings, owners = strings[order], owners[order]
    starts = np.flatnonzero(np.concatenate([[True], strings[1:] != strings[:-1]]))
    return strings[starts], np.minimum.reduceat(owners, starts)


def earlier_windows(body: np.ndarray, bounds: np.ndarray, owners: np.ndarray, length: int, anchor: int,
                    batches: int = BATCHES) -> np.ndarray:
    """For each context and window start within its bounds: does the window start in a smaller document too?"""
    starts = length - anchor + 1
    offsets = np.arange(starts)
    real = (offsets >= bounds[:, :1]) & (offsets < bounds[:, 1:])
    answer = np.zeros((len(body), starts), bool)
    levels = SuffixLevels()
    order = np.argsort(owners, kind="stable")
    cuts = np.unique(np.searchsorted(owners[order], owners[order][np.arange(1, batches) * len(order) // batches]))
    for part in np.split(order, cuts[cuts > 0]):
        row, at = np.nonzero(real[part])
        if not len(row):
            continue
        row = part[row]
        windows = np.lib.stride_tricks.sliding_window_view(body, length, axis=1)[row, at]
        windows = np.ascontiguousarray(windows).view(f"S{length}").ravel()
        array = np.argsort(windows, kind="stable")
        strings, docs = windows[array], owners[row[array]]
        first = np.flatnonzero(np.concatenate([[True], strings[1:] != strings[:-1]]))
        own = np.minimum.reduceat(docs, first)
        distinct = strings[first]
        least = np.repeat(np.minimum(own, levels.scan(distinct)), np.diff(np.append(first, len(strings))))
        answer[row[array], at[array]] = least < docs
        levels.add(distinct, own)
    return answer


def _tell_windows(length: int, anchor: int):
    width = 2 * length - anchor
    starts = length - anchor + 1

    def tell(table: pa.Table) -> pa.Table:
        bounds = [np.frombuffer(x, np.uint8).reshape(-1, 2) for x in table.column("bounds").to_pylist()]
        sizes = np.cumsum([0, *map(len, bounds)])
        body = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, width) for x in table.column("bytes").to_pylist()])
        owners = np.concatenate([packed.from_plain_planes(x) for x in table.column("owners").to_pylist()])
        found = earlier_windows(body, np.concatenate(bounds), owners, length, anchor)
        bits = np.packbits(found, axis=1)
        assert bits.shape[1] == -(-starts // 8)
        return pa.table({
            "_chunk": table.column("chunk"),
            "kind": pa.array([1] * table.num_rows, pa.int32()),
            "bucket": table.column("bucket"),
            "answer": pa.array([bits[a:b].tobytes() for a, b in zip(sizes, sizes[1:])], pa.binary()),
        })

    return tell


def _cut(length: int, anchor: int, buckets: int, context_buckets: int):
    starts = length - anchor + 1
    wide = -(-starts // 8)

    def cut(docs: pa.Table, told: pa.Table) -> pa.Table:
        packed.release()
        own = _Anchors(docs, length, anchor)
        keep = own.shared(_answers(told, 0), buckets)
        prints, body, _, owner, of, at, doc = own.contexts(keep, length, anchor)
        edges = packed.bucket_edges(prints, context_buckets)
        elsewhere = np.zeros((len(prints), starts), bool)
        for b, bits in _answers(told, 1).items():
            rows = np.frombuffer(bits, np.uint8).reshape(-1, wide)
            elsewhere[edges[b]:edges[b + 1]] = np.unpackbits(rows, axis=1, count=starts).astype(bool)
        # A context's answer is about its first document here; later ones repeat that one's windows as well.
        repeated = elsewhere[of]
        later = owner[of] < own.ids[doc]
        begin, end = own.offsets[doc], own.offsets[doc + 1]
        window = at[:, None] - (length - anchor) + np.arange(starts)
        fits = (window >= begin[:, None]) & (window + length <= end[:, None])
        gone = covered(window[(repeated | later[:, None]) & fits], length, len(own.data))
        lost = np.zeros(len(gone) + 1, np.int64)
        np.cumsum(gone, out=lost[1:])
        left, spans = [], []
        for d in range(len(own.ids)):
            a, z = own.offsets[d], own.offsets[d + 1]
            raw = own.data[a:z]
            if lost[a] == lost[z]:
                left.append(None if own.null[d] else raw.tobytes())
                spans.append([])
                continue
            left.append(raw[~gone[a:z]].tobytes())
            spans.append([{"start": int(i), "stop": int(j)} for i, j in zip(*runs(gone[a:z]))])
        return pa.table({
            "_id": pa.array(own.ids, pa.int64()),
            **dict(zip(own.carried.column_names, own.carried.columns)),
            "_text": pa.array(left, pa.binary()),
            "n_bytes": pa.array(np.diff(own.offsets), pa.int64()),
            "n_removed": pa.array(lost[own.offsets[1:]] - lost[own.offsets[:-1]], pa.int64()),
            "spans": pa.array(spans, SPANS_ARROW),
        })

    return cut


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH,
                   anchor: int = ANCHOR, carry: Sequence[str] = (), chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(key, text binary, n_bytes, n_removed, spans, carried columns): texts without bytes that an earlier one has.

    Texts are UTF-8 bytes; what is left need not be valid UTF-8, so it comes as binary. A
    byte goes if a string of ``length`` bytes that covers it also starts in a document with
    a smaller key; strings are judged on the input and never cross documents. ``spans``
    are the maximal removed byte runs [start, stop).

    A null text has no bytes and stays null. Shorter texts than ``length`` keep all. Rows that
    repeat a key count as one document: none removes from another. Rows with a null key
    are not compared and come back whole. Columns named in ``carry`` come back with their
    rows, others are not used. An empty table gives an empty result.
    """
    if not 8 <= anchor < length <= 255:
        raise ValueError("anchors need 8 bytes at least and fewer than a repeated string, which has 255 at most")
    rows, size = packed.dealt(docs, key, text, chunk_bytes, carry)
    # About two anchors lie in (length - anchor + 2) bytes; a third of them shared is plenty.
    expected = 2 * size // (length - anchor + 2)
    buckets = packed.pieces(expected, packed.BUCKET_PRINTS)
    context_buckets = packed.pieces(expected // 3, BUCKET_CONTEXTS)
    by_chunk = rows.groupBy("_chunk")
    shared = by_chunk.applyInArrow(_send_anchors(length, anchor, buckets), ANCHORS).groupBy("bucket").applyInArrow(_tell_shared, TOLD)
    contexts = by_chunk.cogroup(shared.groupBy("_chunk")).applyInArrow(
        _send_contexts(length, anchor, buckets, context_buckets), CONTEXTS)
    told = shared.unionByName(contexts.groupBy("bucket").applyInArrow(_tell_windows(length, anchor), TOLD))
    kinds = "".join(f"_carry{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(carry))
    cut = by_chunk.cogroup(told.groupBy("_chunk")).applyInArrow(
        _cut(length, anchor, buckets, context_buckets),
        f"_id long, {kinds}_text binary, n_bytes long, n_removed long, spans {SPANS}")
    body = F.col(f"`{text}`").cast("string")
    whole = docs.where(F.col(f"`{key}`").isNull()).select(
        F.col(f"`{key}`").cast("long").alias("_id"), *packed.carried(carry), body.cast("binary").alias("_text"),
        F.coalesce(F.octet_length(body), F.lit(0)).cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"), F.array().cast(SPANS).alias("spans"))
    both = cut.unionByName(whole)
    return both.select(F.col("_id").alias(key), F.col("_text").alias(text), "n_bytes", "n_removed", "spans",
                       *(F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)))
