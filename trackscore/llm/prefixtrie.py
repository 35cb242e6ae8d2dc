"""Prefix trie of conversations by union-find over sorted neighbours.

A conversation is its sequence of turns; a node of the trie is a distinct prefix. Sorted
by turns, the members of a node are neighbours, and two neighbours share as many nodes as
their common prefix (LCP) has turns. Inside a sorted partition the LCP edges are taken in
descending depth: each merges two components of a union-find, and a merge of components that
are deeper than the edge makes a branching node with them as children. Runs of nodes with one
child are kept as one component and written out in the end.

The components that touch an end of a partition may go on in the next one. They are the
prefixes of its first and its last row; each partition's forest is contracted to them, and the
contracted nodes of all partitions are merged by what their prefix is. Everything else is
final where it was found.

A conversation of any length is cut into segments of ``SEGMENT`` turns. Segments are sorted
under the prefix before them, so a row stays small; what lies in later segments reaches the
earlier ones as a sum per conversation, counted at each node's smallest member.

Turns are compared by two 64-bit hashes of their SHA-256 digest and position.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ordering import ordered
from ..session import materialize
from . import packed

SEGMENT = 64
PARTITION_TURNS = 200_000
MOST_PARTITIONS = 20_000
CHUNK = 1024
PIECE_IDS = 20_000

CLOSED, OPEN, ENDS = 0, 1, 2
ID = "depth long, k1 long, k2 long"
RAW = ("kind int, part int, conv_id long, depth long, k1 long, k2 long, parent_conv long, u1 long, u2 long, n_convs long, "
       "n_children long, n_leaves long, saved long, own_leaves long, own_saved long, bytes long, more boolean, spine boolean, "
       "ends string, above array<struct<depth:long,k1:long,k2:long>>")
NODES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_table(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role",
               text: str = "text", **plan) -> DataFrame:
    """(conv, pos, digest, bytes, total): turns numbered from 0 in order of ``turn`` (null first).

    ``digest`` is the SHA-256 of role and text (null counts as empty), ``bytes`` the UTF-8
    length of the text, ``total`` the turns of the conversation. Turns with an equal number
    are ordered by digest; repeated rows are turns of their own. Rows with a null conversation
    take no part.
    """
    who = F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(""))
    what = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    named = F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, what)
    rows = conversations.select(
        F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"),
        F.unhex(F.sha2(named.cast("binary"), 256)).alias("digest"), F.octet_length(what).cast("long").alias("bytes"),
    ).where("conv is not null")
    return ordered(rows, ["conv"], ["turn", "digest"], pos="pos", size="total", **plan).rows.drop("turn")


def rebuilt(turns: DataFrame, family: int = 5, most: int = 8) -> DataFrame:
    """Turn table in which every conversation c starts with the first h turns of c - c % family.

    h is the CRC-32 of c in decimal, modulo ``most + 1``; c's own turns after its first h
    follow. A conversation without turns has one row with a null position, so that it stays.
    """
    turns = materialize(turns)
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % F.lit(most + 1)
    convs = turns.where("pos = 0").select("conv", F.col("total").alias("own"), head.alias("h"),
                                          (F.col("conv") - F.col("conv") % family).alias("base"))
    heads = turns.where(F.col("pos") < most).groupBy(F.col("conv").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("heads"))  # ``most`` turns at most
    convs = (convs.join(heads, "base", "left")
             .withColumn("heads", F.slice(F.coalesce("heads", F.array().cast(heads.schema["heads"].dataType)), F.lit(1), F.col("h").cast("int")))
             .withColumn("k", F.size("heads").cast("long"))
             .withColumn("total", F.col("k") + F.greatest(F.lit(0), F.col("own") - F.col("h"))))
    convs = materialize(convs.select("conv", "own", "h", "k", "total", "heads"))
    first = convs.select("conv", F.explode_outer("heads").alias("t"), "total").select(
        "conv", F.col("t.pos").alias("pos"), F.col("t.digest").alias("digest"), F.col("t.bytes").alias("bytes"), "total")
    first = first.where("pos is not null or total = 0")
    # A long conversation meets its row of ``convs`` in chunks.
    spread = convs.where("own > h").select("conv", "h", "k", F.col("total").alias("new_total"), F.explode(
        F.sequence(F.lit(0).cast("long"), F.floor((F.col("own") - 1) / CHUNK))).alias("chunk"))
    rest = (turns.withColumn("chunk", F.floor(F.col("pos") / CHUNK)).join(spread, ["conv", "chunk"]).where("pos >= h")
            .select("conv", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "digest", "bytes",
                    F.col("new_total").alias("total")))
    return first.unionByName(rest)


def _beside(rows: DataFrame, values: dict[str, tuple], later: bool) -> DataFrame:
    """Adds, per conversation, what earlier (or ``later``) segments come to: {out: (aggregate, merge, column)}.

    In two steps over chunks of segments, so a very long conversation is no one task's.
    """
    def order(c: str) -> Column:
        return F.desc(c) if later else F.asc(c)

    rows = rows.withColumn("_chunk", F.floor(F.col("seg") / CHUNK))
    inside = Window.partitionBy("conv", "_chunk").orderBy(order("seg")).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("conv").orderBy(order("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv", "_chunk").agg(*(f(c).alias(f"_t_{o}") for o, (f, _, c) in values.items()))
    totals = totals.select("conv", "_chunk", *(
        F.coalesce(f(f"_t_{o}").over(across), F.lit(0)).alias(f"_a_{o}") for o, (f, _, c) in values.items()))
    local = rows.select("*", *(F.coalesce(f(c).over(inside), F.lit(0)).alias(f"_i_{o}") for o, (f, _, c) in values.items()))
    return local.join(totals, ["conv", "_chunk"]).select(
        *(c for c in rows.columns if c != "_chunk"),
        *(merge(F.col(f"_i_{o}"), F.col(f"_a_{o}")).alias(o) for o, (_, merge, _) in values.items()))


def _segments(turns: DataFrame, segment: int) -> DataFrame:
    """(conv, seg, k1, k2, path, sizes, more): segments, and the hash of all turns before each."""
    lanes = [F.xxhash64(F.lit(i), "pos", "digest") for i in (1, 2)]
    rows = turns.withColumns({"seg": F.coalesce(F.floor(F.col("pos") / segment), F.lit(0)),
                              "l1": F.when(F.col("pos").isNotNull(), lanes[0]), "l2": F.when(F.col("pos").isNotNull(), lanes[1])})
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", "l1", "l2", "bytes"))
    segs = rows.groupBy("conv", "seg").agg(
        F.sort_array(F.collect_list(item)).alias("t"), F.max("total").alias("total"),
        F.coalesce(F.bit_xor("l1"), F.lit(0)).alias("x1"), F.coalesce(F.bit_xor("l2"), F.lit(0)).alias("x2"))
    segs = materialize(segs.select(
        "conv", "seg", "x1", "x2", F.flatten(F.transform("t", lambda x: F.array(x["l1"], x["l2"]))).alias("path"),
        F.col("t.bytes").alias("sizes"), (F.col("total") > (F.col("seg") + 1) * segment).alias("more"),
        (F.col("total") > segment).alias("long")))
    one = segs.where("not long").select("*", F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"))
    xor = lambda a, b: a.bitwiseXOR(b)
    many = _beside(segs.where("long"), {"k1": (F.bit_xor, xor, "x1"), "k2": (F.bit_xor, xor, "x2")}, later=False)
    kept = ("conv", "seg", "k1", "k2", "path", "sizes", "more", "long")
    return materialize(one.select(*kept).unionByName(many.select(*kept)))


def lcp(path: np.ndarray, start: np.ndarray, length: np.ndarray, together: np.ndarray) -> np.ndarray:
    """Common turns of each row and the next; -1 where they are not ``together``. ``path`` has a row of two hashes per turn."""
    out = np.where(together, 0, -1)
    alive, depth = np.flatnonzero(together), 0
    while len(alive):
        alive = alive[(length[alive] > depth) & (length[alive + 1] > depth)]
        same = (path[start[alive] + depth] == path[start[alive + 1] + depth]).all(1)
        alive = alive[same]
        depth += 1
        out[alive] = depth
    return out


class Forest:
    """Components of the rows of a partition, merged by LCP edges in descending depth."""

    def __init__(self, conv, length, sizes_before, start, more, leaves, saved, edges, last_depth):
        self.cum, self.start, self.n = sizes_before, start, len(conv)
        self.depth, self.left, self.right = length.tolist(), list(range(self.n)), list(range(self.n))
        self.count, self.least, self.children = [1] * self.n, conv.tolist(), [0] * self.n
        self.leaves, self.saved, self.more = leaves.tolist(), saved.tolist(), more.tolist()
        self.parent, self.same, self.top = [-1] * self.n, {}, list(range(self.n))
        self.segment = last_depth
        order = np.lexsort((np.arange(len(edges)), -edges))
        for i in order[edges[order] >= 0].tolist():
            self.merge(self.find(i), self.find(i + 1), int(edges[i]))
        for i in range(self.n):  # what is left meets at the start of its segment
            x = self.find(i)
            if self.depth[x]:
                self.attach(x, self.node(0, x))

    def find(self, x: int) -> int:
        while self.top[x] != x:
            self.top[x] = self.top[self.top[x]]
            x = self.top[x]
        return x

    def node(self, depth: int, first: int) -> int:
        """A new branching node over the component ``first``."""
        new = len(self.depth)
        for values, value in ((self.depth, depth), (self.left, self.left[first]), (self.right, self.right[first]), (self.count, 0),
                              (self.least, self.least[first]), (self.children, 0), (self.leaves, 0), (self.saved, 0),
                              (self.more, False), (self.parent, -1), (self.top, new)):
            values.append(value)
        return new

    def spine(self, x: int) -> bool:
        """True where the members may go on in a neighbouring partition."""
        return self.left[x] == 0 or self.right[x] == self.n - 1

    def chain_bytes(self, x: int, above: int) -> int:
        """Bytes of the last texts of the nodes below depth ``above`` down to x."""
        at = self.start[self.left[x]]
        return int(self.cum[at + self.depth[x]] - self.cum[at + above])

    def reach(self, x: int, t: int) -> None:
        self.left[t], self.right[t] = min(self.left[t], self.left[x]), max(self.right[t], self.right[x])
        self.count[t] += self.count[x]
        self.least[t] = min(self.least[t], self.least[x])
        self.top[x] = t

    def attach(self, x: int, t: int) -> None:
        """x becomes a child of t, which is less deep."""
        self.parent[x] = t
        leaves, saved = self.leaves[x], self.saved[x]
        if not self.spine(x):
            self.children[t] += 1
            self.leaves[x] = leaves = leaves + (not self.children[x] and not self.more[x])
            saved += (self.count[x] - 1) * self.chain_bytes(x, self.depth[t])
        self.leaves[t] += leaves
        self.saved[t] += saved
        self.reach(x, t)

    def merge(self, a: int, b: int, depth: int) -> None:
        if self.depth[a] == depth:
            t = a
        else:
            t = self.node(depth, a)
            self.attach(a, t)
        if self.depth[b] != depth:
            self.attach(b, t)
            return
        self.same[b] = t
        self.children[t] += self.children[b]
        self.leaves[t] += self.leaves[b]
        self.saved[t] += self.saved[b]
        self.more[t] = self.more[t] or self.more[b]
        self.reach(b, t)

    def real(self, x: int) -> int:
        while x in self.same:
            x = self.same[x]
        return x


def _forest(segment: int):
    names = [f.split()[0] for f in RAW.replace("depth:long,k1:long,k2:long", "").split(", ")]
    kinds = {"kind": pa.int32(), "part": pa.int32(), "more": pa.bool_(), "spine": pa.bool_(), "ends": pa.string(),
             "above": pa.list_(pa.struct([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())]))}
    schema = pa.schema([(n, kinds.get(n, pa.int64())) for n in names])

    def grow(batches):
        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        part = TaskContext.get().partitionId()
        conv, seg, k1, k2, more, tail_leaves, tail_saved = (
            table.column(c).to_numpy() for c in ("conv", "seg", "k1", "k2", "more", "tail_leaves", "tail_saved"))
        sizes = table.column("sizes").combine_chunks()
        sizes = pa.concat_arrays(sizes.chunks) if isinstance(sizes, pa.ChunkedArray) else sizes
        path = table.column("path").combine_chunks()
        path = pa.concat_arrays(path.chunks) if isinstance(path, pa.ChunkedArray) else path
        length = np.diff(sizes.offsets.to_numpy()).astype(np.int64)
        start = np.concatenate([[0], np.cumsum(length)])[:-1]
        path = path.flatten().to_numpy().reshape(-1, 2)
        cum = np.concatenate([[0], np.cumsum(sizes.flatten().to_numpy())])
        del table
        together = (seg[1:] == seg[:-1]) & (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])
        forest = Forest(conv, length, cum, start, more, tail_leaves, tail_saved, lcp(path, start, length, together), segment)

        def identity(row: int, depth: int) -> tuple[int, int, int]:
            """Depth and hash of the first ``depth`` turns of a row, with what its earlier segments held."""
            own = np.bitwise_xor.reduce(path[start[row]:start[row] + depth], axis=0) if depth else (0, 0)
            return int(seg[row] * segment + depth), int(k1[row] ^ own[0]), int(k2[row] ^ own[1])

        def ends_of(x: int) -> np.ndarray:
            rows = slice(forest.left[x], forest.right[x] + 1)
            return conv[rows][(length[rows] == forest.depth[x]) & ~more[rows]]

        def blank(**values):
            return {**dict.fromkeys(names), "part": part, **values}

        others, closed, known = [], [], {}
        for x in range(len(forest.depth)):
            if x in forest.same:
                continue
            row, depth, base = forest.left[x], forest.depth[x], int(seg[forest.left[x]]) * segment
            up = forest.real(forest.parent[x]) if forest.parent[x] >= 0 else -1
            if depth and not forest.spine(x):
                # Where the segment ends and turns follow, the next segments know the children.
                if depth == segment and forest.more[x]:
                    others.append((x, up))
                else:
                    closed.append((x, up))
                continue
            if not depth and base:  # the node itself belongs to the segment before
                i = identity(row, 0)
                others.append(blank(kind=OPEN, conv_id=forest.least[x], depth=i[0], k1=i[1], k2=i[2], n_convs=0,
                                    n_children=forest.children[x], n_leaves=0, saved=0, bytes=0, more=False, spine=False, above=[]))
                continue
            above = forest.depth[up] if up >= 0 else -1
            lineage = [identity(row, d) for d in range(0 if not base else 1, depth)]
            ups = {i[0]: i for i in [identity(row, d) for d in range(depth)]}
            for d in range(above + 1, depth + 1):
                i, bottom = identity(row, d), d == depth
                u = ups.get(i[0] - 1, (None, None, None))
                others.append(blank(
                    kind=OPEN, conv_id=forest.least[x], depth=i[0], k1=i[1], k2=i[2], u1=u[1], u2=u[2], n_convs=forest.count[x],
                    n_children=forest.children[x] if bottom else 0, n_leaves=forest.leaves[x], saved=forest.saved[x],
                    bytes=int(cum[start[row] + d] - cum[start[row] + d - 1]) if d else 0, more=bool(forest.more[x]) and bottom,
                    spine=True, above=[dict(zip(("depth", "k1", "k2"), j)) for j in lineage if j[0] < i[0]]))
            ids, i = ends_of(x), identity(row, depth)
            for at in range(0, len(ids), PIECE_IDS):
                piece = ids[at:at + PIECE_IDS]
                others.append(blank(kind=ENDS, conv_id=int(piece[0]), depth=i[0], k1=i[1], k2=i[2],
                                    ends=",".join(map(str, piece.tolist()))))

        def parent(up: int):
            """(smallest member, None, None) of a final parent, or the hash of one that is not."""
            if forest.depth[up] and not forest.spine(up):
                return forest.least[up], None, None
            if up not in known:
                known[up] = (None, *identity(forest.left[up], forest.depth[up])[1:])
            return known[up]

        rows = []
        for o in others:
            if isinstance(o, dict):
                rows.append(o)
                continue
            x, up = o
            above, row = forest.depth[up], forest.left[x]
            i, size = identity(row, segment), int(cum[start[row] + segment] - cum[start[row] + segment - 1])
            lone = above == segment - 1
            p = parent(up) if lone else (forest.least[x], None, None)
            rows.append(blank(
                kind=OPEN, conv_id=forest.least[x], depth=i[0], k1=i[1], k2=i[2], parent_conv=p[0], u1=p[1], u2=p[2],
                n_convs=forest.count[x], n_children=0, n_leaves=forest.leaves[x], saved=forest.saved[x] + (forest.count[x] - 1) * size,
                own_leaves=0, own_saved=(forest.count[x] - 1) * size, bytes=size, more=True, spine=False, above=[]))
            ids = ends_of(x)
            for at in range(0, len(ids), PIECE_IDS):
                piece = ids[at:at + PIECE_IDS]
                rows.append(blank(kind=ENDS, conv_id=int(piece[0]), depth=i[0], k1=i[1], k2=i[2],
                                  ends=",".join(map(str, piece.tolist()))))
            if not lone:  # the nodes above it that have one child
                closed.append((x, up))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)
        if not closed:
            return

        x = np.array([c[0] for c in closed])
        parents = [parent(c[1]) for c in closed]
        take = lambda values: np.array(values, dtype=np.int64)[x]
        left, bottom, above = take(forest.left), take(forest.depth), np.array([forest.depth[c[1]] for c in closed])
        count, least, children, leaves, below = map(take, (forest.count, forest.least, forest.children, forest.leaves, forest.saved))
        goes_on = np.array([forest.more[i] and forest.depth[i] == segment for i in x.tolist()])
        stop = bottom - goes_on  # the last node is written above where turns follow
        ends = [NO_ENDS if g else hashlib.sha256(",".join(map(str, ends_of(i).tolist())).encode()).hexdigest()
                for i, g in zip(x.tolist(), goes_on)]
        for a in range(0, len(x), 20_000):
            s = slice(a, a + 20_000)
            reps = (stop - above)[s]
            at = np.repeat(np.arange(len(x))[s], reps)
            depth = np.arange(len(at)) - np.repeat(np.cumsum(reps) - reps, reps) + above[at] + 1
            place = start[left[at]]
            size = cum[place + depth] - cum[place + depth - 1]
            is_top, is_bottom = depth == above[at] + 1, depth == bottom[at]
            up_conv = np.array([p[0] if p[0] is not None else 0 for p in parents])
            up_open = np.array([p[0] is None for p in parents])
            u1, u2 = (np.array([p[i] if p[i] is not None else 0 for p in parents]) for i in (1, 2))
            unknown = is_top & up_open[at]
            n = len(at)
            kids = np.where(is_bottom, children[at], 1)
            ends_at = np.array(ends, dtype=object)[at]
            ends_at[~is_bottom] = NO_ENDS
            nothing = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, CLOSED, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(least[at]),
                pa.array(seg[left[at]] * segment + depth), nothing, nothing,
                pa.array(np.where(is_top, up_conv[at], least[at]), mask=unknown), pa.array(u1[at], mask=~unknown),
                pa.array(u2[at], mask=~unknown), pa.array(count[at]), pa.array(kids), pa.array(leaves[at]),
                pa.array(below[at] + (count[at] - 1) * (cum[place + bottom[at]] - cum[place + depth - 1])),
                pa.array((kids == 0).astype(np.int64)), pa.array((count[at] - 1) * size), pa.array(size),
                pa.array(np.zeros(n, bool)), pa.array(np.zeros(n, bool)), pa.array(ends_at, pa.string()),
                pa.nulls(n, schema.field("above").type)], schema=schema)

    return grow


def _digests(batches):
    """SHA-256 of the id lists whose pieces follow each other; one list at a time, one piece in memory."""
    now, digest = None, None
    fields = [("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())]

    def row():
        return pa.RecordBatch.from_pylist([dict(zip(("depth", "k1", "k2", "ends_sha256"), (*now, digest.hexdigest())))], pa.schema(fields))

    for batch in batches:
        for depth, k1, k2, ends in zip(*(batch.column(c).to_pylist() for c in ("depth", "k1", "k2", "ends"))):
            if (depth, k1, k2) != now:
                if now is not None:
                    yield row()
                now, digest = (depth, k1, k2), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ends.encode())
    if now is not None:
        yield row()


def _nodes(segs: DataFrame, segment: int) -> DataFrame:
    """All nodes below the segments, with what each adds itself (``own_leaves``, ``own_saved``)."""
    spark = segs.sparkSession
    turns = segs.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), packed.pieces(turns, PARTITION_TURNS))
    order = ("seg", "k1", "k2", "path", "conv")
    raw = materialize(segs.repartitionByRange(min(parts, MOST_PARTITIONS), *order).sortWithinPartitions(*order)
                      .mapInArrow(_forest(segment), RAW))
    key = ["depth", "k1", "k2"]
    opened = raw.where(F.col("kind") == OPEN)
    merged = opened.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), *(F.max(c).alias(c) for c in ("parent_conv", "u1", "u2", "bytes", "more", "spine", "above")),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")),
        F.sum(F.coalesce("own_saved", F.lit(0))).alias("own_saved"))
    merged = materialize(merged.where("n_convs > 0 or n_children > 0"))
    # Children that are spines of several partitions are one each.
    spines = merged.where("spine").groupBy((F.col("depth") - 1).alias("depth"), F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(
        F.count(F.lit(1)).alias("_spines"))
    merged = merged.join(spines, key, "left").withColumn("n_children", F.col("n_children") + F.coalesce("_spines", F.lit(0)))
    own_leaf = F.when(F.col("spine"), ((F.col("n_children") == 0) & ~F.col("more")).cast("long")).otherwise(F.lit(0).cast("long"))
    merged = materialize(merged.withColumns({
        "own_leaves": own_leaf,
        "own_saved": F.when(F.col("spine"), (F.col("n_convs") - 1) * F.col("bytes")).otherwise(F.col("own_saved"))}).drop("_spines"))
    added = (merged.where("spine").select(F.explode(F.array_append("above", F.struct(*key))).alias("to"), "own_leaves", "own_saved")
             .groupBy(*(F.col(f"to.{c}").alias(c) for c in key))
             .agg(F.sum("own_leaves").alias("_leaves"), F.sum("own_saved").alias("_saved")))
    digests = (raw.where(F.col("kind") == ENDS).select(*key, "conv_id", "ends").repartition(*key)
               .sortWithinPartitions(*key, "conv_id").mapInArrow(_digests, f"{ID}, ends_sha256 string"))
    least = merged.select(*key, "conv_id")
    upper = least.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"),
                         F.col("conv_id").alias("_up"))
    split = (merged.where("n_convs > 0").join(added, key, "left").join(digests, key, "left")
             .join(upper, ["depth", "u1", "u2"], "left").select(
        "conv_id", "depth", F.coalesce("parent_conv", "_up").alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("n_leaves") + F.coalesce("_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("saved") + F.coalesce("_saved", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"), "own_leaves", "own_saved"))
    closed = raw.where(F.col("kind") == CLOSED)
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
               F.col("ends").alias("ends_sha256"), "own_leaves", "own_saved")
    inner = closed.where("u1 is null").withColumn("parent_conv_id", F.col("parent_conv")).select(*columns)
    # A node that many children share is looked up once per partition.
    seen = opened.select("part", *key).distinct().join(least, key).select(
        "part", (F.col("depth") + 1).alias("depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"),
        F.col("conv_id").alias("parent_conv_id"))
    outer = closed.where("u1 is not null").join(seen, ["part", "depth", "u1", "u2"]).select(*columns)
    return split.unionByName(inner).unionByName(outer)


def prefix_trie(turns: DataFrame, *, segment: int = SEGMENT) -> DataFrame:
    """A row per distinct prefix of the conversations of a turn table (``turn_table`` or ``rebuilt``).

    conv_id: smallest conversation that starts with the prefix; depth: its turns; parent_conv_id:
    that of the prefix one turn shorter (null at the root); n_convs: conversations that start
    with it; n_children, n_leaves: longer prefixes by one turn, and prefixes without longer ones
    below or at it; saved_tokens: sum of (n_convs - 1) * bytes of the last text over it and all
    below; ends_sha256: digest of the ascending ids of the conversations that end there.

    Conversations without turns are members of the root. Copies of one conversation are members
    of the same nodes. An empty table has no nodes, not even a root.
    """
    segs = _segments(turns, segment)
    zero = F.lit(0).cast("long")
    flat = segs.withColumns({"tail_leaves": zero, "tail_saved": zero})
    if not segs.where("long").isEmpty():
        deep = _nodes(flat.where("seg > 0"), segment).groupBy(
            F.col("conv_id").alias("conv"), F.floor((F.col("depth") - 1) / segment).alias("seg")).agg(
            F.sum("own_leaves").alias("own_leaves"), F.sum("own_saved").alias("own_saved"))
        places = segs.where("long").select("conv", "seg").join(deep, ["conv", "seg"], "left")
        plus = lambda a, b: a + b
        tails = _beside(places.fillna(0), {"tail_leaves": (F.sum, plus, "own_leaves"), "tail_saved": (F.sum, plus, "own_saved")},
                        later=True).drop("own_leaves", "own_saved")
        flat = flat.where("not long").unionByName(segs.where("long").join(tails, ["conv", "seg"]))
        flat = materialize(flat)
    return _nodes(flat, segment).select(*NODES)
