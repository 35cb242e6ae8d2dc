"""Approximate nearest neighbours on low-dimensional stable projections.

Every vector is projected by a Gaussian (2-stable) matrix: for a pair at distance d, the
squared projected distance over d**2 follows a chi-square law with as many degrees of freedom
as the projection has dimensions. A kd-tree over a bounded sample of projections cuts the
space into regions; every row is placed in its region, regions are dealt into blocks of
bounded size, and each block keeps a kd-tree of its projections beside the original vectors.

A query takes projected neighbours in ascending order from the kd-tree and verifies them on
the original vectors. With the k-th best distance d found so far, a neighbour nearer than d
lies within projected radius r with at least the probability chi2_cdf(r**2 / d**2); the search
stops when that passes ``confidence`` for all that is left. Queries first search their own
block; the bound found there says which regions can still hold neighbours, and only those
blocks get the query. Queries travel to blocks, blocks are shuffled once per search round.

Equal vectors are folded first: of each distinct vector only the few smallest ids can be
among anyone's nearest, and equal queries search once.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .topk import usable

DIMS = 10
CONFIDENCE = 0.98
SEED = 20
#: Rows the region tree is fitted on, drawn by a hash of the id; regions; rows of a block and of a leaf.
SAMPLE = 20_000
REGIONS = 1024
BLOCK = 8192
LEAF = 32
PACKET = 256
SALTS = 16

POINTS = "vec_id long, digest binary, v array<double>, p array<double>"
INDEX = "region int, sub int, size long, dims long, ids binary, data binary, points binary, cuts binary, boxes binary"
PACKETS = "region int, sub int, digests binary, n long, q_dims long, q_data binary, q_points binary, bounds binary"
FOUND = "digest binary, vec_id long, squared double"


def chi_square_cdf(m: int, x: float) -> float:
    """P(chi-square with m degrees of freedom <= x), by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, half = m / 2, x / 2
    if half > a + 40 * math.sqrt(a) + 40:
        return 1.0
    term = total = 1.0
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= half / (a + n)
        total += term
    return min(1.0, total * math.exp(a * math.log(half) - half - math.lgamma(a + 1)))


def chi_square_quantile(m: int, p: float) -> float:
    """The x with P(chi-square <= x) = p."""
    low, high = 0.0, 1.0
    while chi_square_cdf(m, high) < p:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(m, middle) < p else (low, middle)
    return high


def projection(dims: int, m: int, seed: int) -> np.ndarray:
    """The first ``dims`` rows of the Gaussian matrix; a longer vector uses further rows of the same matrix."""
    return np.random.Generator(np.random.PCG64(seed)).standard_normal((dims, m))


def _matrix(column) -> np.ndarray:
    """Lists of doubles as rows; shorter ones are padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    dims = int(lengths.max(initial=0))
    if (lengths == dims).all():
        return flat.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims))
    out[np.arange(dims)[None, :] < lengths[:, None]] = flat
    return out


def _projector(m: int, seed: int):
    def project(batches):
        rows = np.zeros((0, m))
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v")) + 0.0  # minus zero and zero are one value
            if v.shape[1] > len(rows):
                rows = projection(v.shape[1], m, seed)
            p = v @ rows[:v.shape[1]]
            digests = [hashlib.md5(np.trim_zeros(x, "b").tobytes()).digest() for x in v]
            as_lists = lambda a: pa.ListArray.from_arrays(
                np.arange(0, a.size + 1, max(1, a.shape[1]), dtype=np.int32)[:len(a) + 1], pa.array(a.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(digests, pa.binary()), as_lists(v), as_lists(p)],
                names=["vec_id", "digest", "v", "p"])

    return project


def projected(rows: DataFrame, key: str, vector: str, m: int, seed: int) -> DataFrame:
    """(vec_id, digest, v, p) of the usable non-zero vectors."""
    v = F.col(f"`{vector}`").cast("array<double>")
    kept = (rows.select(F.col(f"`{key}`").cast("long").alias("vec_id"), v.alias("v"))
            .where(F.col("vec_id").isNotNull() & usable(F.col("v")) & F.exists("v", lambda x: x != 0)))
    return kept.mapInArrow(_projector(m, seed), POINTS)


class Tree:
    """A kd-tree of medians in heap order: node i has the children 2i+1 and 2i+2; the last level are regions."""

    def __init__(self, points: np.ndarray, levels: int):
        inner = (1 << levels) - 1
        self.levels, self.dim, self.value = levels, np.zeros(inner, np.int32), np.zeros(inner)
        parts = [points]
        for node in range(inner):
            part = parts[node]
            if len(part):
                self.dim[node] = np.argmax(np.ptp(part, axis=0))
                self.value[node] = np.median(part[:, self.dim[node]])
            left = part[:, self.dim[node]] <= self.value[node]
            parts += [part[left], part[~left]]

    def place(self, points: np.ndarray) -> np.ndarray:
        """Region of every point."""
        node = np.zeros(len(points), np.int64)
        for _ in range(self.levels):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.dim[node]] > self.value[node])
        return node - ((1 << self.levels) - 1)


def _leaves(points: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Points in kd-tree order and the cuts between leaves of ``size`` points at most."""
    order, cuts, stack = [], [0], [np.arange(len(points))]
    while stack:
        part = stack.pop()
        if len(part) <= size:
            order.append(part)
            cuts.append(cuts[-1] + len(part))
            continue
        dim = int(np.argmax(np.ptp(points[part], axis=0)))
        half = len(part) // 2
        split = part[np.argpartition(points[part, dim], half)]
        stack += [split[half:], split[:half]]
    return np.concatenate(order), np.array(cuts, np.int64)


def _pack(table: pa.Table) -> pa.Table:
    """One block: vectors in vertical layout, in the order of the kd-tree over their projections."""
    table = table.sort_by([("vec_id", "ascending"), ("digest", "ascending")])
    ids, v, p = table.column("vec_id").to_numpy(), _matrix(table.column("v")), _matrix(table.column("p"))
    order, cuts = _leaves(p, LEAF)
    ids, v, p = ids[order], v[order], p[order]
    boxes = np.stack([np.minimum.reduceat(p, cuts[:-1]), np.maximum.reduceat(p, cuts[:-1])])
    return pa.table({
        "region": pa.array([table.column("region")[0].as_py()], pa.int32()),
        "sub": pa.array([table.column("sub")[0].as_py()], pa.int32()),
        "size": pa.array([len(ids)], pa.int64()), "dims": pa.array([v.shape[1]], pa.int64()),
        **{name: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())
           for name, x in (("ids", ids), ("data", v.T), ("points", p), ("cuts", cuts), ("boxes", boxes))},
    })


def _gap(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances from a point to boxes."""
    out = np.maximum(low - point, 0) + np.maximum(point - high, 0)
    return np.einsum("ij,ij->i", out, out)


class Block:
    """A block of the index, unpacked."""

    def __init__(self, row: dict, m: int):
        n = row["size"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.data = np.frombuffer(row["data"]).reshape(row["dims"], n)
        self.points = np.frombuffer(row["points"]).reshape(n, m)
        self.cuts = np.frombuffer(row["cuts"], np.int64)
        self.low, self.high = np.frombuffer(row["boxes"]).reshape(2, -1, m)

    def squared(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Squared distances, summed one dimension after another."""
        dims = min(len(query), len(self.data))
        part = self.data[:dims, rows] - query[:dims, None]
        rest = self.data[dims:, rows] if len(self.data) > dims else None
        total = np.add.reduce(part * part, axis=0)
        if rest is not None:
            total = total + np.add.reduce(rest * rest, axis=0)
        for x in query[dims:]:
            total = total + x * x
        return total

    def search(self, query: np.ndarray, point: np.ndarray, k: int, bound: float, quantile: float):
        """(ids, squared distances, verified rows) of the ``k`` best found; ``bound`` is a squared k-th distance known."""
        leaf_gap = _gap(point, self.low, self.high)
        order = np.argsort(leaf_gap)
        best_ids, best = np.zeros(0, np.int64), np.zeros(0)
        pool, pool_gap = np.zeros(0, np.int64), np.zeros(0)
        at, step, verified = 0, 4, 0
        while True:
            taken = order[at:at + step]
            taken = taken[leaf_gap[taken] <= quantile * bound]
            if len(taken):
                rows = np.concatenate([np.arange(self.cuts[i], self.cuts[i + 1]) for i in taken])
                apart = self.points[rows] - point
                pool = np.concatenate([pool, rows])
                pool_gap = np.concatenate([pool_gap, np.einsum("ij,ij->i", apart, apart)])
            at += step
            horizon = leaf_gap[order[at]] if at < len(order) else math.inf
            ready = pool_gap <= horizon  # no point of a later leaf is nearer than these
            now = pool[ready][np.argsort(pool_gap[ready])]
            gaps = np.sort(pool_gap[ready])
            pool, pool_gap = pool[~ready], pool_gap[~ready]
            for a in range(0, len(now), 256):
                inside = int(np.searchsorted(gaps[a:a + 256], quantile * bound, "right"))
                if not inside:
                    break
                rows = now[a:a + inside]
                verified += len(rows)
                found = self.squared(query, rows)
                near = found <= bound
                best_ids, best = np.concatenate([best_ids, self.ids[rows[near]]]), np.concatenate([best, found[near]])
                top = np.lexsort((best_ids, best))[:k]
                best_ids, best = best_ids[top], best[top]
                if len(best) == k:
                    bound = min(bound, best[-1])
            left = min(horizon, pool_gap.min(initial=math.inf))
            if left > quantile * bound or left == math.inf:
                return best_ids, best, verified
            step *= 2


def _searcher(m: int, k: int, quantile: float):
    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block, n = Block(row, m), row["n"]
                queries = np.frombuffer(row["q_data"]).reshape(n, row["q_dims"])
                points, bounds = np.frombuffer(row["q_points"]).reshape(n, m), np.frombuffer(row["bounds"])
                digests, ids, squares = [], [], []
                for j in range(n):
                    near, squared, _ = block.search(queries[j], points[j], k, bounds[j], quantile)
                    digests += [row["digests"][16 * j:16 * j + 16]] * len(near)
                    ids.append(near)
                    squares.append(squared)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.binary()), pa.array(np.concatenate(ids)), pa.array(np.concatenate(squares))],
                    names=["digest", "vec_id", "squared"])

    return search


def _packets(batches):
    """Neighbouring rows of one block as packets of ``PACKET`` queries at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        region, sub = batch.column("region").to_numpy(), batch.column("sub").to_numpy()
        change = np.flatnonzero((np.diff(region) != 0) | (np.diff(sub) != 0)) + 1
        edges = [0, *change, batch.num_rows]
        for a, z in zip(edges, edges[1:]):
            for at in range(a, z, PACKET):
                part = batch.slice(at, min(PACKET, z - at))
                v, p = _matrix(part.column("v")), _matrix(part.column("p"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(region[at])], pa.int32()), pa.array([int(sub[at])], pa.int32()),
                     pa.array([b"".join(part.column("digest").to_pylist())], pa.binary()),
                     pa.array([len(v)], pa.int64()), pa.array([v.shape[1]], pa.int64()),
                     pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()),
                     pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()),
                     pa.array([part.column("bound").to_numpy().tobytes()], pa.binary())],
                    names=[f.split()[0] for f in PACKETS.split(", ")])


def _placer(tree: Tree, subs: np.ndarray | None):
    """Adds the region, and with ``subs`` (blocks of each region) the block a row belongs to."""
    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            region = tree.place(_matrix(batch.column("p")))
            columns, names = [*batch.columns, pa.array(region.astype(np.int32))], [*batch.schema.names, "region"]
            if subs is not None:
                spread = np.array([int.from_bytes(d[:7], "big") for d in batch.column("digest").to_pylist()], np.int64)
                columns.append(pa.array((spread % np.maximum(1, subs[region])).astype(np.int32)))
                names.append("sub")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return place


def _router(low: np.ndarray, high: np.ndarray, subs: np.ndarray, quantile: float):
    """A row for every block that can hold a neighbour, but for the query's own block."""
    def route(batches):
        for batch in batches:
            points, bounds = _matrix(batch.column("p")), batch.column("bound").to_numpy()
            home, own = batch.column("region").to_numpy(), batch.column("sub").to_numpy()
            for i in range(batch.num_rows):
                near = np.flatnonzero((subs > 0) & (_gap(points[i], low, high) <= quantile * bounds[i]))
                region = np.repeat(near, subs[near])
                sub = np.concatenate([np.arange(subs[r]) for r in near]) if len(near) else near
                away = (region != home[i]) | (sub != own[i])
                row = batch.slice(i, 1)
                if away.any():
                    again = pa.array(np.zeros(int(away.sum()), np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [*(row.column(c).take(again) for c in ("digest", "v", "p", "bound")),
                         pa.array(region[away].astype(np.int32)), pa.array(sub[away].astype(np.int32))],
                        names=["digest", "v", "p", "bound", "region", "sub"])

    return route


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, *, key: str = "vec_id", vector: str = "embedding",
            dims: int = DIMS, confidence: float = CONFIDENCE, seed: int = SEED, block: int = BLOCK,
            sample: int = SAMPLE, regions: int = REGIONS) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the ``k`` nearest found for each query, by Euclidean distance.

    ``queries`` has the columns of ``vectors``. A neighbour is missed with a probability of
    ``1 - confidence`` at most; the distance of what is returned is exact. Ties go to the
    smaller id. Rows with a null id, or a vector that is null, zero or has a null or non-finite
    component take no part. Rows with the query's own id are no candidates of it; other
    repeated ids stay separate candidates, and a repeated query id asks once, with the vector
    smallest in array order. A shorter vector counts as padded with zeros. Empty tables give
    an empty result.
    """
    quantile = chi_square_quantile(dims, confidence)
    asked = projected(queries, key, vector, dims, seed).groupBy("vec_id").agg(F.min(F.struct("v", "p", "digest")).alias("q"))
    asked = materialize(asked.select("vec_id", "q.*"))
    points = projected(vectors, key, vector, dims, seed)
    # A query's own rows are dropped from its list, so the list is longer by as many.
    repeats = points.join(asked.select("vec_id"), "vec_id").groupBy("vec_id").count().agg(F.max("count")).first()[0] or 0
    most = k + repeats
    smallest = Window.partitionBy("digest").orderBy("vec_id")
    points = materialize(points.withColumn("_n", F.row_number().over(smallest)).where(F.col("_n") <= most).drop("_n"))
    total = points.count()
    spark = vectors.sparkSession
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    share = max(1, math.ceil(0.8 * sample / total * (1 << 30))) if total > sample else 1 << 30
    drawn = points.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < share).select("p").limit(sample).toArrow()
    levels = max(0, min(math.ceil(math.log2(max(1, total / block))), int(math.log2(regions)),
                        int(math.log2(max(1, drawn.num_rows // 8)))))
    tree = Tree(_matrix(drawn.column("p")) if drawn.num_rows else np.zeros((0, dims)), levels)

    region_kinds = f"{POINTS}, region int"
    boxes = points.mapInArrow(_placer(tree, None), region_kinds).groupBy("region").agg(
        F.count(F.lit(1)).alias("n"), *(f(F.col("p")[i]).alias(f"{name}{i}") for i in range(dims)
                                        for name, f in (("low", F.min), ("high", F.max)))).collect()
    subs = np.zeros(1 << levels, np.int64)
    low, high = np.zeros((1 << levels, dims)), np.zeros((1 << levels, dims))
    for row in boxes:
        subs[row.region] = math.ceil(row.n / block)
        low[row.region], high[row.region] = ([row[f"{name}{i}"] for i in range(dims)] for name in ("low", "high"))
    index = materialize(points.mapInArrow(_placer(tree, subs), f"{region_kinds}, sub int")
                        .groupBy("region", "sub").applyInArrow(_pack, INDEX))

    def searched(assigned: DataFrame) -> DataFrame:
        # Ranges over (block, query), so a block that many queries ask is spread over tasks.
        packets = (assigned.repartitionByRange("region", "sub", "digest").sortWithinPartitions("region", "sub", "digest")
                   .mapInArrow(_packets, PACKETS))
        return packets.join(index, ["region", "sub"]).mapInArrow(_searcher(dims, most, quantile), FOUND)

    distinct = asked.groupBy("digest").agg(F.first("v").alias("v"), F.first("p").alias("p"))
    home = materialize(
        distinct.select(F.lit(0).cast("long").alias("vec_id"), "digest", "v", "p").mapInArrow(
            _placer(tree, subs), f"{region_kinds}, sub int").drop("vec_id"))
    first = materialize(searched(home.withColumn("bound", F.lit(math.inf))))
    bounds = first.groupBy("digest").agg(
        F.when(F.count(F.lit(1)) >= most, F.max("squared")).otherwise(F.lit(math.inf)).alias("bound"))
    known = home.join(bounds, "digest", "left").withColumn("bound", F.coalesce("bound", F.lit(math.inf)))
    routed = known.select("digest", "v", "p", "bound", "region", "sub").mapInArrow(
        _router(low, high, subs, quantile),
        "digest binary, v array<double>, p array<double>, bound double, region int, sub int")
    found = first.unionByName(searched(materialize(routed)))
    per_digest = Window.partitionBy("digest").orderBy("squared", "vec_id")
    lists = found.withColumn("_n", F.row_number().over(per_digest)).where(F.col("_n") <= most).drop("_n")
    # A vector that many queries share: its short list goes to several places, the queries are dealt over them.
    lists = lists.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    own = asked.select(F.col("vec_id").alias("query_id"), "digest",
                       F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("_salt"))
    ranked = Window.partitionBy("query_id").orderBy("squared", "vec_id")
    return (own.join(lists, ["digest", "_salt"]).where(F.col("query_id") != F.col("vec_id"))
            .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", F.sqrt("squared").alias("score")))
