"""Projected nearest neighbours: recall and exact scores against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from trackscore.llm import projections
from trackscore.llm.projections import chi_square_cdf, chi_square_quantile, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, region int, digest string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "s") for i, v in rows], SCHEMA).repartition(5)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, asked, k):
    """{(query, rank): (id, distance)} of the exact neighbours."""
    fine = [(i, [float(np.float32(x)) for x in v]) for i, v in rows if i is not None and usable(v)]
    dims = max((len(v) for _, v in fine), default=0)
    ids = np.array([i for i, _ in fine])
    x = np.array([v + [0.0] * (dims - len(v)) for _, v in fine])
    out = {}
    for q in sorted(set(ids[np.isin(ids, list(asked))])):
        v = min(x[ids == q].tolist())
        d = np.sqrt(np.add.reduce((x.T - np.array(v)[:, None]) ** 2, axis=0))
        others = np.flatnonzero(ids != q)
        for r, j in enumerate(others[np.lexsort((ids[others], d[others]))][:k], 1):
            out[q, r] = (ids[j], d[j])
    return out


def check(got, want, recall):
    assert {(r.query_id, r["rank"]) for r in got} == set(want)
    rows = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got}
    hits = Counter((q, i) for (q, _), (i, _) in rows.items()) & Counter((q, i) for (q, _), (i, _) in want.items())
    assert hits.total() >= recall * len(want)
    exact = {(q, i): d for (q, r), (i, d) in want.items()}
    for (q, r), (i, d) in rows.items():
        assert (q, i) not in exact or exact[q, i] == d
        assert r == 1 or (rows[q, r - 1][1], rows[q, r - 1][0]) <= (d, i)


def clustered(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dims)) * 3
    return [(i, (centres[i % 20] + rng.normal(size=dims)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_recall_in_many_blocks(spark, seed):
    rows = clustered(3000, 32, seed)
    data = table(spark, rows)
    got = nearest(data, data.where("vec_id % 50 = 0"), 10, block=200).collect()
    check(got, brute(rows, {i for i, _ in rows if i % 50 == 0}, 10), 0.9)


def test_awkward_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.0, 1.0, rng.gauss(0, 1)]) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, rows[10][1]) for i in range(60)]  # more copies than neighbours asked for
    rows += [(300, None), (301, []), (302, [0.0] * 6), (303, [None] * 6), (304, [math.nan] * 6), (305, [math.inf] * 6),
             (None, rows[1][1]), (306, [-0.0] * 6), (307, rows[2][1][:3]), (10, rows[10][1]), (20, rows[21][1]), (20, rows[22][1]),
             (310, [-0.0, 1.0]), (311, [0.0, 1.0, 0.0])]
    data = table(spark, rows)
    asked = {i for i, _ in rows if i is not None and i % 10 == 0}
    for block in (8192, 16):
        got = nearest(data, data.where("vec_id % 10 = 0"), 7, confidence=1 - 1e-12, block=block).collect()
        check(got, brute(rows, asked, 7), 1.0)
    assert not {r.query_id for r in got} & {300, 302}


def test_fewer_candidates_than_asked_and_empty_tables(spark):
    rows = clustered(4, 5, 9)
    data = table(spark, rows)
    check(nearest(data, data.where("vec_id = 0")).collect(), brute(rows, {0}, 10), 1.0)
    assert nearest(data.where("false"), data).collect() == []
    assert nearest(data, data.where("false")).collect() == []
    assert nearest(data.where("vec_id = 1"), data.where("vec_id = 1")).collect() == []


def test_search_verifies_less_than_everything():
    """The stopping test saves most of the work where neighbours are near."""
    rows = clustered(4000, 24, 3)
    x = np.array([v for _, v in rows])
    p = x @ projections.projection(24, 10, 1)
    order, cuts = projections._leaves(p, 32)
    boxes = np.stack([np.minimum.reduceat(p[order], cuts[:-1]), np.maximum.reduceat(p[order], cuts[:-1])])
    packed = {"size": len(x), "dims": 24, "ids": order.astype(np.int64).tobytes(), "data": x[order].T.tobytes(),
              "points": p[order].tobytes(), "cuts": cuts.tobytes(), "boxes": boxes.tobytes()}
    block = projections.Block(packed, 10)
    verified = [block.search(x[i], p[i], 10, math.inf, chi_square_quantile(10, 0.95))[2] for i in range(0, 4000, 200)]
    assert np.mean(verified) < 1000


def test_chi_square():
    # Tabulated upper points of the chi-square law.
    for m, p, x in ((1, 0.95, 3.841), (8, 0.95, 15.507), (10, 0.99, 23.209), (10, 0.05, 3.940)):
        assert chi_square_quantile(m, p) == pytest.approx(x, abs=1e-3)
    assert chi_square_cdf(4, 0) == 0 and chi_square_cdf(4, 1e6) == 1
