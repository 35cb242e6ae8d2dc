"""Exact top-k against brute force."""

import math
import random

from trackscore.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, block int, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "s") for i, v in rows], SCHEMA)


def brute(rows, queries, k):
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in fine:
        if i in queries:
            asked[i] = min(v, asked.get(i, v))
    out = []
    for q, v in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def vectors(n, dims, seed=5):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.gauss(0, 1)]) for _ in range(dims)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(15)]  # ties
    rows += [(n + 20, None), (n + 21, [None] * dims), (n + 22, [math.nan] * dims), (n + 23, [math.inf] * dims), (None, rows[0][1]),
             (n + 24, rows[1][1][: dims // 2]), (n + 25, []), (3, rows[4][1]), (10, rows[9][1])]
    # Spark stores floats, so compare what it stores.
    import numpy as np

    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def test_agrees_with_brute_force_in_any_blocks(spark):
    rows = vectors(160, 37)
    data = table(spark, rows)
    queries = {i for i in range(200) if i % 10 == 0}
    for blocks in ({}, {"candidate_block": 13, "query_block": 4, "dim_block": 5}):
        got = topk.top_k(data, data.where("vec_id % 10 = 0"), 7, **blocks).collect()
        assert sorted(map(tuple, got)) == brute(rows, queries, 7)


def test_fewer_candidates_than_k_and_empty_tables(spark):
    rows = vectors(160, 8)[:4]
    data = table(spark, rows)
    got = topk.top_k(data, data.where("vec_id = 0"), 10).collect()
    assert sorted(map(tuple, got)) == brute(rows, {0}, 10) and len(got) == 3
    assert topk.top_k(data.where("false"), data.where("vec_id = 0")).collect() == []
    assert topk.top_k(data, data.where("false")).collect() == []
