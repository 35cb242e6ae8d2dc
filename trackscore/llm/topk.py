"""Exact top-k inner products by columnar branch-and-bound.

Candidates and queries are dealt into blocks of bounded size; every pair of blocks is
one unit of work, so neither side is ever held whole. In a block the candidates lie in
vertical layout (one row per dimension). Scores accumulate one block of dimensions at a
time; what a candidate can still gain is at most the product of the norms of the
dimensions not yet seen, and candidates that cannot reach the k-th best lower bound are
compacted away. Each pair of blocks yields at most k rows per query; a window ranks them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCALE = 1024
CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 512
DIM_BLOCK = 16
EXACT = 2.0**53

PACKED = "block long, ids binary, dims long, data binary"
FOUND = "query_id long, vec_id long, score long"


def usable(vector: Column) -> Column:
    """True where the vector and all its components are present and finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def integer_vectors(rows: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): usable vectors as floor(scale * component)."""
    v = F.col(f"`{vector}`").cast("array<double>")
    return (rows.select(F.col(f"`{key}`").cast("long").alias("vec_id"), v.alias("v"))
            .where(F.col("vec_id").isNotNull() & usable(F.col("v")))
            .select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v")))


def _pack(table: pa.Table, layout: str) -> pa.Table:
    """One row: ids and an int64 matrix. Short vectors are padded with zeros."""
    lists = table.column("v").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.diff(lists.offsets.to_numpy())
    dims = int(lengths.max(initial=0))
    matrix = np.zeros((len(lengths), dims), np.int64)
    matrix[np.arange(dims)[None, :] < lengths[:, None]] = flat
    if layout == "vertical":
        matrix = np.ascontiguousarray(matrix.T)
    return pa.table({
        "block": pa.array([table.column("block")[0].as_py()], pa.int64()),
        "ids": pa.array([table.column("vec_id").to_numpy().tobytes()], pa.binary()),
        "dims": pa.array([dims], pa.int64()),
        "data": pa.array([matrix.tobytes()], pa.binary()),
    })


def _suffix_norms(matrix: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Norm of what lies at or after each cut; ``matrix`` has a row per dimension."""
    squares = np.square(matrix.astype(np.float64))
    parts = np.add.reduceat(squares, cuts, axis=0)
    return np.sqrt(np.cumsum(parts[::-1], axis=0)[::-1])


def search_block(query_ids, queries, ids, columns, k: int, dim_block: int = DIM_BLOCK):
    """Best ``k`` of one block for each query: (query ids, candidate ids, scores).

    ``queries`` has a row per query, ``columns`` a row per dimension.
    """
    dims = min(queries.shape[1], columns.shape[0])  # what one side lacks counts as zero
    if not dims:
        queries, columns, dims = np.zeros((len(query_ids), 1), np.int64), np.zeros((1, len(ids)), np.int64), 1
    queries, columns = queries[:, :dims], columns[:dims]
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(columns).max(initial=0)) * dims
    if top < EXACT:  # sums stay exact in doubles, whose products are faster
        queries, columns = queries.astype(np.float64), columns.astype(np.float64)
    elif top >= 2.0**63:
        raise ValueError("scores do not fit 64-bit integers")
    cuts = list(range(0, dims, dim_block))
    ends = [*cuts[1:], dims]
    query_rest, column_rest = _suffix_norms(queries.T, cuts), _suffix_norms(columns, cuts)
    first = queries[:, : ends[0]] @ columns[: ends[0]]
    out = []
    for q in range(len(query_ids)):
        alive = np.flatnonzero(ids != query_ids[q])
        sums = first[q, alive]
        for b in range(1, len(cuts)):
            rest = query_rest[b, q] * column_rest[b, alive] * (1 + 1e-9) + 1e-6
            if len(alive) > k:
                low = sums - rest
                bar = np.partition(low, len(low) - k)[len(low) - k]
                keep = sums + rest >= bar
                alive, sums = alive[keep], sums[keep]
            sums = sums + queries[q, cuts[b]:ends[b]] @ columns[cuts[b]:ends[b], alive]
        sums = sums.astype(np.int64)
        best = np.lexsort((ids[alive], -sums))[:k]
        out.append((np.full(len(best), query_ids[q]), ids[alive][best], sums[best]))
    return [np.concatenate(x) if out else np.zeros(0, np.int64) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def _searcher(k: int, dim_block: int):
    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                query_ids, ids = np.frombuffer(row["query_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                queries = np.frombuffer(row["query_data"], np.int64).reshape(len(query_ids), row["query_dims"])
                columns = np.frombuffer(row["data"], np.int64).reshape(row["dims"], len(ids))
                q, c, s = search_block(query_ids, queries, ids, columns, k, dim_block)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (q, c, s)],
                                                 names=["query_id", "vec_id", "score"])

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, *, key: str = "vec_id", vector: str = "embedding",
          scale: int = SCALE, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK,
          dim_block: int = DIM_BLOCK) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k best candidates of each query.

    ``queries`` has the columns of ``vectors``. Components count as floor(scale * x) and
    the score is their inner product; ties go to the smaller id. Rows with a null id, a
    null vector or a null or non-finite component take no part. Rows with the query's own
    id are no candidates of it. Repeated ids among candidates stay separate candidates;
    a repeated query id asks once, with the vector smallest in array order. A shorter
    vector counts as padded with zeros. Empty tables give an empty result.
    """
    items = integer_vectors(vectors, key, vector, scale)
    asked = integer_vectors(queries, key, vector, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_blocks = max(1, math.ceil(items.count() / candidate_block))
    n_query_blocks = max(1, math.ceil(asked.count() / query_block))

    def packed(rows, n, seed, layout):
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(seed), "v"), F.lit(n)))
        return dealt.groupBy("block").applyInArrow(lambda t: _pack(t, layout), PACKED)

    left = (packed(items, n_blocks, 1, "vertical")
            .withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1)).cast("array<long>"))))
    right = (packed(asked, n_query_blocks, 2, "horizontal")
             .select(F.col("block").alias("query_block"), F.col("ids").alias("query_ids"),
                     F.col("dims").alias("query_dims"), F.col("data").alias("query_data"),
                     F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<long>")).alias("block")))
    found = left.join(right, ["block", "query_block"]).mapInArrow(_searcher(k, dim_block), FOUND)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
