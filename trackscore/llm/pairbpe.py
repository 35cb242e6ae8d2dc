"""BPE encoding and decoding by a pair occurrence index.

The distinct words of a batch of texts are laid end to end as one symbol array. An index
maps each mergeable pair, by its rank, to all its positions; active ranks are applied in
ascending order, each at all its positions at once, and the pairs that a merge creates join
the lists of their ranks. A word's lowest active pair is thus always merged first, which is
what encoding words one by one does. Results are remembered within a task, so a word is
merged once and texts are put together from their words.

The vocabulary file is read on the driver from a path that is a parameter, and travels to
the tasks as a broadcast; it is a fixed few MB.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed

MEMO = 30_000  # pre-tokens, and as many words, that a task remembers
STEP_BYTES = 1_500_000  # of texts whose new pre-tokens are merged together


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte, as byte-level vocabularies use."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


@dataclass
class Vocabulary:
    """A byte-level BPE with word ends: what its JSON file says."""

    ids: dict[str, int]
    merges: list[tuple[str, str]]
    pattern: str
    suffix: str
    special: dict[str, int]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if (model["type"], kinds, [p["type"] for p in before], spec["decoder"], spec["post_processor"]) != (
                "BPE", ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], None, None):
            raise ValueError(f"{path} is not a lower-casing byte-level BPE with word ends")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return cls(model["vocab"], merges, before[0]["pattern"]["Regex"], model["end_of_word_suffix"] or "",
                   {t["content"]: t["id"] for t in spec["added_tokens"]})

    def tables(self) -> dict:
        """What coding needs, as arrays and built-in types: tasks can load it without this package."""
        ids, symbols = self.ids, byte_symbols()
        names = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        base = max(names) + 1
        first: dict[int, int] = {}
        for rank, (a, b) in enumerate(self.merges):
            first.setdefault(ids[a] * base + ids[b], rank)
        keys = np.array(sorted(first), np.int64)
        return {
            "pattern": self.pattern, "special": dict(self.special), "names": [names.get(i, "") for i in range(base)],
            "inner": np.array([ids.get(s, -1) for s in symbols], np.int64),
            "last": np.array([ids.get(s + self.suffix, -1) for s in symbols], np.int64),
            "keys": keys, "ranks": np.array([first[k] for k in keys.tolist()], np.int64),
            "made": np.array([ids[a + b] for a, b in self.merges], np.int64),
            "left": np.array([ids[a] for a, _ in self.merges], np.int64),
            "right": np.array([ids[b] for _, b in self.merges], np.int64),
        }


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """Ascending distinct values."""
    values = np.sort(np.concatenate(parts) if len(parts) > 1 else parts[0])
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) > 1 else values


class Coder:
    """Encodes and decodes with the tables of one vocabulary; a task makes one."""

    def __init__(self, tables: dict):
        self.special, self.names, self.base = tables["special"], tables["names"], len(tables["names"])
        self.inner, self.last, self.keys, self.ranks, self.made, self.left, self.right = (
            tables[name] for name in ("inner", "last", "keys", "ranks", "made", "left", "right"))
        self.pattern = regex.compile(tables["pattern"])
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("|".join(map(regex.escape, marks))) if marks else None
        self.memo: dict[bytes, str] = {}
        self.words: dict[bytes, str] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it does not merge."""
        pair = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where((self.keys[at] == pair) & (left >= 0) & (right >= 0), self.ranks[at], -1)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece (non-empty bytes of one pre-token)."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(sizes)
        n = len(data)
        symbol = self.inner[data]
        symbol[ends - 1] = self.last[data[ends - 1]]
        after = np.arange(1, n + 1)
        after[ends - 1] = n  # n stands for no neighbour
        before = np.arange(-1, n - 1)
        before[ends - sizes] = n
        symbol = np.append(symbol, -1)
        after, before = np.append(after, n), np.append(before, n)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            rank = self.rank_of(symbol[at], symbol[after[at]])
            known = rank >= 0
            at, rank = at[known], rank[known]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(rank)]
            for a, z in zip(cuts, cuts[1:]):
                r = int(rank[a])
                if r in index:
                    index[r].append(at[a:z])
                else:
                    index[r] = [at[a:z]]
                    heapq.heappush(active, r)

        add(np.arange(n))
        while active:
            rank = heapq.heappop(active)
            at = _distinct(index.pop(rank))
            left, right, new = self.left[rank], self.right[rank], self.made[rank]
            at = at[(symbol[at] == left) & (symbol[after[at]] == right)]
            if left == right and len(at) > 1:  # in a run of equal symbols every second pair goes
                keep, taken = np.ones(len(at), bool), -1
                follows = after[at[:-1]] == at[1:]
                for i in range(len(at)):
                    if i and follows[i - 1] and taken == i - 1:
                        keep[i] = False
                    else:
                        taken = i
                at = at[keep]
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            symbol[at], symbol[gone] = new, -1
            after[at] = beyond
            before[beyond] = at  # the entry n takes any value: it is never read as a neighbour
            before[n] = n
            earlier = before[at]
            add(_distinct([at, earlier[earlier < n]]))
        alive = symbol[:n] >= 0
        counts = np.add.reduceat(alive.astype(np.int64), ends - sizes)
        return np.split(symbol[:n][alive], np.cumsum(counts)[:-1])

    def pieces_of(self, word: str) -> list[bytes | int]:
        """Pre-tokens of a white-space word as bytes, special tokens as ids."""
        out: list[bytes | int] = []
        at = 0
        for mark in self.marks.finditer(word) if self.marks and "<" in word else ():
            out += self._plain(word[at:mark.start()])
            out.append(self.special[mark.group()])
            at = mark.end()
        return out + self._plain(word[at:])

    def _plain(self, part: str) -> list[bytes]:
        if not part:
            return []
        # Lower case letter by letter, so a final capital sigma is no exception.
        low = unicodedata.normalize("NFC", part).replace("\u03a3", "\u03c3").lower()
        if low.isascii():
            return [m.encode() for m in self.pattern.findall(low)]
        # Code points without a category count as neither letters nor numbers.
        seen = "".join(["\ufffd" if unicodedata.category(c) == "Cn" else c for c in low])
        return [low[m.start():m.end()].encode("utf-8", "surrogatepass") for m in self.pattern.finditer(seen)]

    def encode_words(self, words: list[bytes]) -> list[str]:
        """Ids of each distinct white-space word, in decimal, joined by one space."""
        known = self.words
        unseen = [w for w in words if w not in known]
        if len(known) + len(unseen) > MEMO:
            known = self.words = {w: known[w] for w in words if w in known}
        if unseen:
            cut = [self.pieces_of(w.decode("utf-8")) for w in unseen]
            wanted = {p for parts in cut for p in parts if type(p) is bytes}
            new = [p for p in wanted if p not in self.memo]
            if len(self.memo) + len(new) > MEMO:
                self.memo = {p: self.memo[p] for p in wanted if p in self.memo}
            if new:
                self.memo.update(zip(new, (" ".join(map(str, ids.tolist())) for ids in self.merge(new))))
            memo = self.memo
            known.update(zip(unseen, (" ".join([memo[p] if type(p) is bytes else str(p) for p in parts]) for parts in cut)))
        return [known[w] for w in words]

    def encode(self, column) -> tuple[list[str], list[str]]:
        """(ids, decoded text) of each text of an Arrow string column."""
        words = packed.Words(*packed.utf8_column(column))
        ids = self.encode_words(words.vocabulary.to_pylist())
        names = [self.decode(map(int, i.split(" "))) if i else "" for i in ids]
        out, back = [], []
        hollow = "" in ids  # words of white space beyond ASCII have no tokens
        for a, z in zip(words.first, words.first[1:]):
            own = words.codes[a:z].tolist()
            if hollow:
                own = [c for c in own if ids[c]]
            out.append(" ".join([ids[c] for c in own]))
            back.append(" ".join([names[c] for c in own]))
        return out, back

    def decode(self, ids) -> str:
        """Names of the tokens joined by one space, special tokens among them."""
        names = self.names
        return " ".join([names[i] for i in ids])


def _text_sizes(batch: pa.RecordBatch) -> np.ndarray:
    return pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _steps(batches):
    """The batches' rows again, in steps of about ``STEP_BYTES`` of text, one row at least."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(_text_sizes(batch))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + STEP_BYTES - size, side="right")))
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1] - base)
            at = to
            if size >= STEP_BYTES or at < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _coded(vocabulary):
    def coded(batches):
        coder = Coder(vocabulary.value)
        for step in _steps(batches):
            ids, back = coder.encode(step.column("_text"))
            counts = np.fromiter((i.count(" ") + 1 if i else 0 for i in ids), np.int64, len(ids))
            done = pa.table([*step.columns[:-1], pa.array(counts), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                            names=[*step.column_names[:-1], "_n", "_ids", "_decoded"])
            del step, ids, back
            yield from done.to_batches(max_chunksize=packed.BATCH_ROWS)
            del done
            packed.release(collect=False)
        packed.release()

    return coded


def encode(docs: DataFrame, vocabulary_path: str, *, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``token_ids`` (decimal, joined by one space) and ``decoded``.

    Columns of those names are replaced. Null and empty texts have no tokens. Every row is
    kept, repeated rows too; an empty table gives an empty result. Texts are read whole:
    memory of a task is bounded by a batch of texts and its memo. No shuffle.

    ``token_ids`` are those of the vocabulary's own library without added special tokens;
    special tokens that a text spells out are recognised. ``decoded`` is the library's
    decoding without skipping special tokens: the file names no decoder, so token names
    are joined by spaces.
    """
    packed.small_batches(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(vocabulary_path).tables())
    kept = [c for c in docs.columns if c not in ("n_tokens", "token_ids", "decoded")]
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), F.col(f"`{text}`").cast("string").alias("_text"))
    schema = ", ".join([*(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)),
                        "_n long, _ids string, _decoded string"])
    return inner.mapInArrow(_coded(vocabulary), schema).select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), F.col("_n").alias("n_tokens"),
        F.col("_ids").alias("token_ids"), F.col("_decoded").alias("decoded"))
