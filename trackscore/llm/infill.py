"""Fill-in-the-middle rearrangement of texts by displacement scatter.

A text is cut into lines and two cuts drawn from its id split it into prefix, middle and
suffix. The pieces change places between three marks. Bytes of a batch of texts lie in one
buffer; a piece moves as a whole, so the shift of a byte from input to output changes only
where a piece starts. The changes form a difference array whose cumulative sum is every
byte's shift: one scatter writes all outputs of a batch, and one gather along the same
shifts, found again from the marks in the outputs, restores the texts.

Every text is handled in the task that reads it; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import packed

# The marks before prefix, suffix and middle, and the seed before the id.
MARKS = ("<P>", "<S>", "<M>")
SEED = "7"
RATE = 100
SPM_SHARE = 50
#: Bytes of text handled at once, and positions whose shifts are held at once.
STEP_BYTES = 4_000_000
SLICE = 1 << 20

#: Order of the pieces (0 prefix, 1 middle, 2 suffix) in the output of a form.
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
PLAIN = "plain"


def draws(key: Column, seed: str = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers from the digest of ``seed:key``; a null key counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


class Lines:
    """Line starts of a batch of texts, and code points before every byte."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        after = np.flatnonzero(data == 0x0A) + 1
        begin, end = offsets[:-1], offsets[1:]
        # A line starts at the start of a non-empty text and after each line end inside it.
        self.starts = np.unique(np.concatenate([begin[begin < end], after[~np.isin(after, end)]]))
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.end = end

    def cut(self, at: np.ndarray) -> np.ndarray:
        """Byte where ``at`` lines of each text end."""
        whole = at >= self.counts
        where = np.minimum(self.first[:-1] + at, max(len(self.starts) - 1, 0))
        return np.where(whole, self.end, self.starts[where] if len(self.starts) else self.end)


def _find(data: np.ndarray, mark: bytes) -> np.ndarray:
    """Positions of ``mark`` in the buffer."""
    hits = np.flatnonzero(data[: max(0, len(data) - len(mark) + 1)] == mark[0])
    for k in range(1, len(mark)):
        hits = hits[data[hits + k] == mark[k]]
    return hits


def _inside(hits: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """Text of each hit that lies wholly inside one text, as (hit, text) rows."""
    text = np.searchsorted(offsets, hits, "right") - 1
    whole = hits + size <= offsets[text + 1]
    return np.stack([hits[whole], text[whole]])


def marked(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts contain a mark."""
    found = np.zeros(len(offsets) - 1, bool)
    for mark in MARKS:
        found[_inside(_find(data, mark.encode()), offsets, len(mark))[1]] = True
    return found


def shifts(starts: np.ndarray, moves: np.ndarray, total: int):
    """(from, to, shift of every byte) in slices: the cumulative sum of the differences at the piece starts.

    ``starts`` ascend and begin with 0; ``moves`` is the shift from each start on.
    """
    step = np.diff(moves, prepend=0)
    carry = 0
    for at in range(0, total, SLICE):
        stop = min(total, at + SLICE)
        change = np.zeros(stop - at, np.int64)
        a, z = np.searchsorted(starts, [at, stop])
        np.add.at(change, starts[a:z] - at, step[a:z])  # empty pieces start where the next one does
        change[0] += carry
        shift = np.cumsum(change)
        carry = shift[-1]
        yield at, stop, shift


def _placed(lengths: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where pieces and marks lie in the outputs: (piece starts, mark starts, output offsets).

    ``lengths`` has a row per text and a column per piece; a plain text is all prefix.
    """
    sizes = np.array([len(m) for m in MARKS])[[0, 2, 1]]  # by piece: prefix, middle, suffix
    moved = forms != PLAIN
    offsets = np.zeros(len(forms) + 1, np.int64)
    np.cumsum(lengths.sum(1) + moved * sizes.sum(), out=offsets[1:])
    pieces, marks = np.tile(offsets[:-1, None], 3), np.full((len(forms), 3), -1, np.int64)
    for form, order in ORDERS.items():
        rows = np.flatnonzero(forms == form)
        at = offsets[rows]
        for piece in order:
            marks[rows, piece] = at
            at = at + sizes[piece]
            pieces[rows, piece] = at
            at = at + lengths[rows, piece]
    plain = ~moved
    pieces[plain, 1] = pieces[plain, 2] = offsets[1:][plain]
    return pieces, marks, offsets


def scatter(data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the rearranged texts; ``cuts`` are the byte positions where prefix and middle end."""
    bounds = np.stack([offsets[:-1], cuts[:, 0], cuts[:, 1], offsets[1:]], 1)
    pieces, marks, out_offsets = _placed(np.diff(bounds, axis=1), forms)
    out = np.zeros(out_offsets[-1], np.uint8)
    for at, stop, shift in shifts(bounds[:, :3].ravel(), (pieces - bounds[:, :3]).ravel(), len(data)):
        out[np.arange(at, stop) + shift] = data[at:stop]
    for piece, mark in enumerate((MARKS[0], MARKS[2], MARKS[1])):
        where = marks[:, piece][marks[:, piece] >= 0]
        for k, byte in enumerate(mark.encode()):
            out[where + k] = byte
    return out, out_offsets


def gather(out: np.ndarray, offsets: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts before ``scatter``, from the outputs and their forms alone."""
    moved = np.flatnonzero(forms != PLAIN)
    n = len(forms)
    lengths = np.zeros((n, 3), np.int64)
    lengths[:, 0] = np.diff(offsets)
    places = np.full((n, 3), -1, np.int64)
    for piece, mark in enumerate((MARKS[0], MARKS[2], MARKS[1])):
        hits, text = _inside(_find(out, mark.encode()), offsets, len(mark))
        places[text[::-1], piece] = hits[::-1]  # the first of each text
    if (places[moved] < 0).any():
        raise ValueError("a rearranged text lacks a mark")
    for form, order in ORDERS.items():
        rows = np.flatnonzero(forms == form)
        ends = [*(places[rows, p] for p in order[1:]), offsets[rows + 1]]
        for piece, end in zip(order, ends):
            mark = len(MARKS[(0, 2, 1)[piece]])
            lengths[rows, piece] = end - places[rows, piece] - mark
    pieces, _, _ = _placed(lengths, forms)
    back = np.zeros(n + 1, np.int64)
    np.cumsum(lengths.sum(1), out=back[1:])
    starts = back[:-1, None] + np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(lengths, 1)[:, :2]], 1)
    text = np.empty(back[-1], np.uint8)
    for at, stop, shift in shifts(starts.ravel(), (pieces - starts).ravel(), len(text)):
        text[at:stop] = out[np.arange(at, stop) + shift]
    return text, back


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [
        None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.string())


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES):
    """Slices of a batch whose texts hold ``limit`` bytes at most, or one longer text."""
    size = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _code_points(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Code points between neighbours of each row of ``bounds``."""
    lead = np.zeros(len(data) + 1, np.int32 if len(data) < 2**31 else np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return np.diff(lead[bounds], axis=1).astype(np.int64)


def _mover(rate: int, spm: int):
    def move(batches):
        for batch in batches:
            for part in steps(batch, "_text"):
                data, offsets = packed.utf8_column(part.column("_text"))
                h = np.stack([part.column(f"_h{i}").to_numpy() for i in range(4)], 1)
                lines = Lines(data, offsets)
                n = lines.counts.astype(np.int64)
                a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
                cuts = np.stack([lines.cut(np.minimum(a, b)), lines.cut(np.maximum(a, b))], 1)
                plain = (np.diff(offsets) == 0) | marked(data, offsets) | (h[:, 2] % 100 >= rate)
                forms = np.where(plain, PLAIN, np.where(h[:, 3] % 100 < spm, "spm", "psm"))
                cuts[plain] = offsets[1:, None][plain]
                out, out_offsets = scatter(data, offsets, cuts, forms)
                chars = _code_points(data, np.stack([offsets[:-1], cuts[:, 0], cuts[:, 1]], 1))
                others = [c for c in part.schema.names if c not in ("_text", "_h0", "_h1", "_h2", "_h3")]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in others), pa.array(n), pa.array(forms.astype(object), pa.string()),
                     pa.array(chars[:, 0], mask=plain), pa.array(chars[:, 1], mask=plain), _strings(out, out_offsets)],
                    names=[*others, "_n", "_form", "_prefix", "_middle", "_output"])

    return move


def transform(docs: DataFrame, *, key: str = "doc_id", text: str = "text", carry: Sequence[str] = (), seed: str = SEED,
              rate: int = RATE, spm: int = SPM_SHARE) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output, carried columns): every text rearranged for infilling.

    n counts the lines. The prefix ends after the smaller of two draws from 0..n lines, the
    middle after the larger. ``form`` is ``plain`` (the text as it is, lengths null) for an
    empty text, a text that contains a mark, and a share of ``100 - rate`` percent; else
    ``spm`` for ``spm`` percent and ``psm``. All draws depend on the key alone, so repeated
    rows give repeated results. A null text is empty, a null key draws like an empty one.
    Lengths are code points. An empty table gives an empty result.
    """
    h = draws(F.col(f"`{key}`"), seed)
    rows = docs.select(F.col(f"`{key}`").alias("_id"), *packed.carried(carry),
                       F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"),
                       *(h[i].alias(f"_h{i}") for i in range(4)))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name == "_id" or f.name.startswith("_carry"))
    moved = rows.mapInArrow(_mover(rate, spm), f"{kept}, _n long, _form string, _prefix long, _middle long, _output string")
    return moved.select(
        F.col("_id").alias(key), F.col("_n").alias("n"), F.col("_form").alias("form"), F.col("_prefix").alias("prefix_chars"),
        F.col("_middle").alias("middle_chars"), F.col("_output").alias("output"),
        *(F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)))


def _restorer(batches):
    for batch in batches:
        for part in steps(batch, "output"):
            out, offsets = packed.utf8_column(part.column("output"))
            text, back = gather(out, offsets, part.column("form").to_numpy(zero_copy_only=False).astype(str))
            yield pa.RecordBatch.from_arrays([*part.columns, _strings(text, back)], names=[*part.schema.names, "restored"])


def restore(moved: DataFrame) -> DataFrame:
    """The rows of ``moved`` (with columns ``form`` and ``output``) and the text that each output came from."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in moved.schema)
    return moved.mapInArrow(_restorer, f"{kinds}, restored string")
