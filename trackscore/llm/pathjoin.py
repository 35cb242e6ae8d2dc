"""Near-duplicate groups by chosen-path set similarity join.

A document is its set of word shingles, summarised by ``COORDINATES`` minwise hashes.
Documents with equal sets form one class. Classes descend independent random trees: a
node picks one of the coordinates (sometimes two, 1 / similarity on average) and its
members branch on their minwise value there. Nodes of at most ``LEAF`` members are
compared exhaustively on the summaries; larger ones branch again. A pair at the
threshold keeps one shared node per tree on average, and the trees together reach the
target recall.

Nodes that stay large after ``DEPTH`` branchings hold groups of close copies. Such a node
compares each member with its most central one first. Once those links are confirmed, nodes
whose members are all in one component say nothing new and end. The members of the others
meet by the rare ends of their full sets (prefix filter): what lies outside the main component
of a shingle meets the rest, as far as sizes and what follows the shingle allow. That is
exact, so no link between members of large nodes is missed, and costs pairs only where components still differ.

Candidate links are confirmed on the full sets. Links within one component say nothing
new, so confirmation runs twice, blocks of sets at a time: first on the links most likely to join groups, then on
every candidate between what are still different components. No link between
components is skipped, and no list of all pairs of a group is made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import packed
from .components import components

COORDINATES = 64
TREES = 12
LEAF = 32
DEPTH = 4
PART = 2000  # members of large nodes that meet at one shingle in one task
BLOCK_SHINGLES = 250_000  # of the sets that one task compares with those of another block
LEAST_BLOCKS = 8
SLACK = 0.175  # of the threshold, that summaries may stay below it

SUMMARY = "_id long, n long, class binary, sig array<int>"
SETS = "node long, shingles array<long>"


def shingle_hashes(words: packed.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every shingle; a document of fewer words has one, of all its words."""
    prints, doc = packed.mixed(packed.rolling(words.hash, width)), words.doc
    starts = np.flatnonzero(doc[:len(prints)] == doc[width - 1:]) if len(prints) else np.zeros(0, np.int64)
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < width))
    own = np.zeros(len(short), np.uint64)
    for i, d in enumerate(short):
        sequence = np.concatenate([words.hash[words.first[d]:words.first[d + 1]], np.array([counts[d]], np.uint64)])
        own[i] = packed.mixed(packed.rolling(sequence, len(sequence)))[0]
    hashes, docs = np.concatenate([prints[starts], own]), np.concatenate([doc[starts], short])
    order = np.argsort(docs, kind="stable")
    return hashes[order], docs[order]


def _batch_sets(batch, width: int):
    words = packed.Words(*packed.utf8_column(batch.column("_text")), lower=True)
    return shingle_hashes(words, width)


def _summarise(width: int, coordinates: int):
    rng = np.random.default_rng(20)
    factors = rng.integers(1, 1 << 63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def summarise(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                hashes, docs = _batch_sets(batch, width)
                ids, first = np.unique(docs, return_index=True)
                first = np.append(first, len(hashes))
                sizes, classes = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
                for d, a, z in zip(ids, first, first[1:]):
                    own = np.unique(hashes[a:z])
                    sizes[d] = len(own)
                    with np.errstate(over="ignore"):
                        sums = own.sum(dtype=np.uint64), packed.mixed(own ^ packed.ODD).sum(dtype=np.uint64)
                    classes[d] = b"".join(int(x).to_bytes(8, "big") for x in sums)
                signature = np.zeros((batch.num_rows, coordinates), np.int32)
                if len(ids):
                    for c in range(coordinates):
                        with np.errstate(over="ignore"):
                            spread = hashes * factors[c]
                        spread ^= spread >> np.uint64(29)
                        with np.errstate(over="ignore"):
                            spread *= packed.MIX[1]
                        least = np.minimum.reduceat(spread, first[:-1])
                        signature[ids, c] = (least >> np.uint64(32)).astype(np.uint32).view(np.int32)
                offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * coordinates
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), pa.array(sizes), pa.array(classes, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(signature.reshape(-1)))],
                    names=["_id", "n", "class", "sig"])
        packed.release()

    return summarise


def _full_sets(width: int):
    def full_sets(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                hashes, docs = _batch_sets(batch, width)
                ids, first = np.unique(docs, return_index=True)
                sets = [np.unique(x).view(np.int64) for x in np.split(hashes, first[1:])] if len(ids) else []
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").take(pa.array(ids)), pa.array(sets, pa.list_(pa.int64()))],
                    names=["node", "shingles"])
        packed.release()

    return full_sets


def _draw(*parts, below: int) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(below)).cast("int")


def _children(rows: DataFrame, coordinates: int, threshold: float) -> DataFrame:
    """Branch members (key, node, sig): one coordinate per node, a second often enough for 1 / threshold."""
    first = _draw("key", F.lit(1), below=coordinates)
    second = F.when(_draw("key", F.lit(2), below=1000) < F.lit(int(1000 * (1 / threshold - 1))),
                    _draw("key", F.lit(3), below=coordinates))
    at = F.explode(F.array_distinct(F.array_compact(F.array(first, second))))
    return (rows.withColumn("at", at)
            .select(F.xxhash64("key", "at", F.element_at("sig", F.col("at") + 1)).alias("key"), "node", "n", "sig"))


def _agreement(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def _may_link(threshold: float, coordinates: int) -> Column:
    """Sizes and summaries allow a link; half the coordinates is far below what linked sets share."""
    smaller, larger = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    return (smaller >= larger * F.lit(threshold) - F.lit(1e-6)) & (
        _agreement("a.sig", "b.sig") >= F.lit(int(coordinates * (threshold - SLACK))))


def candidate_links(nodes: DataFrame, *, threshold: float, coordinates: int, trees: int, leaf: int, depth: int):
    """((u, v, alike) candidate pairs with u < v, (key, node, n, sig) members of nodes that stay large)."""
    trunk = nodes.withColumn("key", F.explode(F.lit(list(range(trees))))).withColumn("key", F.xxhash64("key", F.lit("tree")))
    rows = _children(trunk, coordinates, threshold).select("key", "node")  # most end here, so summaries stay behind
    leaves, dense = [], None
    for level in range(1, depth + 1):
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        shared = materialize(rows.join(sizes, "key"))
        small, large = shared.where(F.col("members") <= leaf), shared.where(F.col("members") > leaf)
        if level == 1:
            small, large = small.join(nodes, "node"), large.join(nodes, "node")
        leaves.append(small.select("key", "node", "n", "sig"))
        dense = large.select("key", "node", "n", "sig")
        if level == depth or large.isEmpty():
            break
        rows = _children(dense, coordinates, threshold)
    small = leaves[0]
    for more in leaves[1:]:
        small = small.unionByName(more)
    pairs = small.alias("a").join(small.alias("b"), (F.col("a.key") == F.col("b.key"))
                                  & (F.col("a.node") < F.col("b.node")) & _may_link(threshold, coordinates))
    return _as_pairs(pairs), dense


def _as_pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v"),
                         _agreement("a.sig", "b.sig").alias("alike"))


def _central_links(dense: DataFrame, threshold: float, coordinates: int) -> DataFrame:
    """Every member of a large node with the node's most central member and its smallest.

    What the members of a group were made from follows their common values furthest, so
    the member of most large nodes is the most central.
    """
    uses = dense.groupBy("node").agg(F.count(F.lit(1)).alias("uses"))
    chosen = dense.select("key", "node").join(uses, "node").groupBy("key").agg(
        F.max_by("node", F.struct("uses", -F.col("node"))).alias("central"), F.min("node").alias("first"))
    pivots = (chosen.select("key", F.explode(F.array_distinct(F.array("central", "first"))).alias("node"))
              .join(dense, ["key", "node"]))
    return _as_pairs(dense.alias("a").join(pivots.alias("b"), (F.col("a.key") == F.col("b.key"))
                                           & (F.col("a.node") != F.col("b.node")) & _may_link(threshold, coordinates)))


def _linked(percent: int):
    """Of the pairs of two blocks of sets, those that are similar enough."""
    def linked(pairs, sets):
        at = {node: i for i, node in enumerate(sets.column("node").to_pylist())}
        shingles = sets.column("shingles").combine_chunks()
        if isinstance(shingles, pa.ChunkedArray):  # no chunk at all
            shingles = pa.array([], pa.list_(pa.int64()))
        values, offsets = shingles.values.to_numpy(zero_copy_only=False), shingles.offsets.to_numpy()
        us, vs = pairs.column("u").to_numpy(), pairs.column("v").to_numpy()
        keep = np.zeros(len(us), bool)
        for i, (u, v) in enumerate(zip(us.tolist(), vs.tolist())):
            if u in at and v in at:
                a, b = (values[offsets[at[x]]:offsets[at[x] + 1]] for x in (u, v))
                if min(len(a), len(b)) * 100 >= max(len(a), len(b)) * percent:
                    common = len(a) + len(b) - len(np.union1d(a, b))
                    keep[i] = common * 100 >= (len(a) + len(b) - common) * percent
        return pa.table([pa.array(us[keep], pa.int64()), pa.array(vs[keep], pa.int64())], names=["u", "v"])

    return linked


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets are similar enough.

    Sets are dealt into blocks of about ``BLOCK_SHINGLES``. Two blocks meet with the pairs between
    them, so a set moves once for each block that it has a partner in, not once for each pair.
    """
    total = sets.agg(F.sum(F.size("shingles"))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, packed.pieces(total, BLOCK_SHINGLES))

    def block(node: str) -> Column:
        return F.pmod(F.xxhash64(F.col(node)), F.lit(blocks))

    pairs = materialize(pairs.select("u", "v").distinct())
    placed = pairs.select(F.least(block("u"), block("v")).alias("low"), F.greatest(block("u"), block("v")).alias("high"), "u", "v")
    needed = placed.select("low", "high", F.explode(F.array("u", "v")).alias("node")).distinct()
    moved = needed.join(sets.select("node", "shingles"), "node").select(
        F.col("low").alias("one"), F.col("high").alias("other"), "node", "shingles")
    return (placed.groupBy("low", "high").cogroup(moved.groupBy("one", "other"))
            .applyInArrow(_linked(percent), "u long, v long"))


def _likely(pairs: DataFrame, coordinates: int, threshold: float) -> DataFrame:
    """For each node its smallest likely partner and its most similar one."""
    ways = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "alike"))
    best = ways.groupBy("u").agg(
        F.min(F.when(F.col("alike") >= int(coordinates * threshold), F.col("v"))).alias("first"),
        F.max_by("v", F.struct("alike", -F.col("v"))).alias("best"))
    return (best.select("u", F.explode(F.array_distinct(F.array_compact(F.array("first", "best")))).alias("v"))
            .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())


def _rooted(rows: DataFrame, roots: DataFrame, node: str, root: str) -> DataFrame:
    named = roots.select(F.col("node").alias(node), F.col("root").alias(root))
    return rows.join(named, node, "left").withColumn(root, F.coalesce(root, node))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80,
                    coordinates: int = COORDINATES, trees: int = TREES, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """(key, n_shingles, component_id, kept): one row per row of ``docs``.

    A-Z count as lower case and words lie between ASCII white space. A set has the distinct
    shingles of ``width`` words; a shorter text has one shingle, all its words; an empty,
    blank or null text has none and links with nothing. Texts link where 100 * shared >=
    ``percent`` * union; equal sets always link. component_id is the smallest key
    reachable and ``kept`` marks its document.

    Rows that repeat a key are one document with several texts. Rows with a null key link
    with nothing; their component_id is null and they are kept. Other columns of ``docs``
    are not used. An empty table gives an empty result.
    """
    threshold = percent / 100
    packed.small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    summary = materialize(rows.mapInArrow(_summarise(width, coordinates), SUMMARY))
    whole = summary.where("_id is not null and n > 0")
    nodes = materialize(whole.groupBy("class").agg(
        F.min("_id").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    pairs, dense = candidate_links(nodes.select("node", "n", "sig"), threshold=threshold, coordinates=coordinates,
                                   trees=trees, leaf=leaf, depth=depth)
    crowded = not dense.isEmpty()
    if crowded:
        pairs = pairs.unionByName(_central_links(dense, threshold, coordinates))
    pairs = materialize(pairs.where("u <> v").groupBy("u", "v").agg(F.max("alike").alias("alike")))
    ends = pairs.select("u").unionByName(pairs.select(F.col("v").alias("u"))).distinct()
    if crowded:
        ends = ends.unionByName(dense.select(F.col("node").alias("u"))).distinct()
    sets = materialize(rows.join(ends.withColumnRenamed("u", "_id"), "_id", "left_semi")
                       .mapInArrow(_full_sets(width), SETS))

    likely = materialize(_likely(pairs, coordinates, threshold))
    links = materialize(_confirmed(likely, sets, percent))
    roots = components(links)
    rest = _rooted(_rooted(pairs.select("u", "v"), roots, "u", "ru"), roots, "v", "rv").where("ru <> rv").select("u", "v")
    if crowded:
        rest = rest.unionByName(_left_over(dense, roots, sets, percent))
    rest = rest.distinct().join(likely, ["u", "v"], "left_anti")
    links = links.unionByName(_confirmed(rest, sets, percent))
    # A repeated key ties the classes of its texts together.
    named = (summary.join(nodes.select("class", "node"), "class", "left")
             .withColumn("node", F.when(F.col("_id").isNotNull(), F.col("node"))))
    member = named.where("node is not null").select(F.col("_id").alias("u"), F.col("node").alias("v"))
    several = member.groupBy("u").agg(F.min("v").alias("least"), F.max("v").alias("most")).where("least <> most")
    links = links.unionByName(member.join(several.select("u"), "u", "left_semi"))
    roots = components(links)
    found = _rooted(named.withColumn("node", F.coalesce("node", "_id")), roots, "node", "component_id")
    kept = F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True))
    return found.select(F.col("_id").alias(key), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def _prefixes(dense: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(shingle, node, root, n, rest): the shingles by which members of large nodes can meet another component.

    Linked sets share a shingle among the first n - ceil(n * percent / 100) + 1 of either, in
    any common order. Those of one component only come first, then the others, rare
    ones first; ``rest`` counts what follows in the whole set.
    """
    members = _rooted(dense.select("key", "node").distinct(), roots, "node", "root")
    mixed = members.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    still = members.join(mixed.select("key"), "key", "left_semi").select("node", "root").distinct()
    own = sets.join(still, "node").select("node", "root", F.size("shingles").alias("n"), F.xxhash64("shingles").alias("own"),
                                          F.explode("shingles").alias("shingle"))
    uses = own.groupBy("shingle").agg(F.count(F.lit(1)).alias("uses"), F.min("root").alias("least"), F.max("root").alias("most"))
    shared = (own.join(uses.where("least <> most").select("shingle", "uses"), "shingle").groupBy("node", "own", "root", "n")
              .agg(F.sort_array(F.collect_list(F.struct("uses", "shingle"))).alias("shared")))
    needed = F.floor((F.col("n") * F.lit(percent) + F.lit(99)) / F.lit(100))
    room = (F.size("shared") - needed + F.lit(1)).cast("int")
    return (shared.withColumn("room", room).where("room > 0")
            .select("node", "root", "n", F.size("shared").alias("of"), F.posexplode(F.slice("shared", F.lit(1), F.col("room"))).alias("at", "one"))
            .select("one.shingle", "node", "root", "n", (F.col("of") - F.col("at") - F.lit(1)).alias("rest")))


def _left_over(dense: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidates among members of large nodes that are still in different components; no link is left out."""
    reached = materialize(_prefixes(dense, roots, sets, percent))
    sizes = reached.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("size"))
    main = (sizes.groupBy("shingle").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.sum("size").alias("size"),
                                         F.count(F.lit(1)).alias("roots"))
            .where("roots > 1").select("shingle", "main", F.ceil(F.col("size") / F.lit(PART)).cast("int").alias("parts")))
    named = reached.join(main, "shingle")
    # The members of a hot shingle are spread over parts, and those outside its main component visit all parts.
    every = named.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    outside = named.where("root <> main").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # The first shingle that two sets share is followed by all others that they share.
    common = F.least("a.rest", "b.rest") + F.lit(1)
    met = every.alias("a").join(outside.alias("b"), (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.part") == F.col("b.part"))
                                & (F.col("a.root") != F.col("b.root"))
                                & (F.least("a.n", "b.n") * F.lit(100) >= F.greatest("a.n", "b.n") * F.lit(percent))
                                & (common * F.lit(100 + percent) >= (F.col("a.n") + F.col("b.n")) * F.lit(percent)))
    return met.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()
