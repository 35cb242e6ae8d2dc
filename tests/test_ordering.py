"""The plain and the hot-group plan must give the same, brute-force checked, results."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from track_help import HOT
from pyspark.sql import functions as F

from trackscore.operators.ordering import cumulative_by_value, hash_rank, ordered
from trackscore.operators.tracks import tracks

PLANS = [{}, HOT, {"hot_rows": 3, "chunk_rows": 2}]


def sorted_track(frame):
    out = frame.sort_values(["video_id", "timestamp", "row_ord"]).reset_index(drop=True)
    out["pos"] = out.groupby("video_id").cumcount()
    out["track_rows"] = out.groupby("video_id")["row_ord"].transform("size")
    return out


@pytest.mark.parametrize("plan", PLANS)
def test_positions(skewed, plan):
    df, frame = skewed
    track = tracks(df, **plan)
    assert track.hot == bool(plan)
    got = track.rows.select("row_ord", "pos", "track_rows").toPandas().set_index("row_ord").sort_index()
    want = sorted_track(frame).set_index("row_ord")[["pos", "track_rows"]].sort_index()
    assert got.equals(want.astype("int64"))


@pytest.mark.parametrize("plan", PLANS)
def test_lag_lead_and_running(skewed, plan):
    df, frame = skewed
    track = tracks(df, **plan).lag("row_ord", "before", 2).lead("row_ord", "after", 1)
    track = track.running(total=("sum", "action_id"), top=("max", "score"), low=("min", "score"))
    got = track.rows.select("row_ord", "before", "after", "total", "top", "low").toPandas()
    got = got.set_index("row_ord").sort_index()
    want = sorted_track(frame)
    group = want.groupby("video_id")
    want["before"] = group["row_ord"].shift(2)
    want["after"] = group["row_ord"].shift(-1)
    want["total"] = group["action_id"].cumsum()
    want["top"] = group["score"].cummax()
    want["low"] = group["score"].cummin()
    want = want.set_index("row_ord").sort_index()
    for column in got.columns:
        pd.testing.assert_series_equal(got[column], want[column], check_dtype=False)


def test_running_skips_nulls_across_chunks(skewed):
    df, frame = skewed
    rare = F.when(F.col("row_ord") % 97 == 0, F.col("row_ord"))
    results = []
    for plan in ({}, HOT):
        track = tracks(df.withColumn("rare", rare), **plan).running(seen=("max", "rare"))
        results.append(track.rows.select("row_ord", "seen").toPandas().sort_values("row_ord").reset_index(drop=True))
    pd.testing.assert_frame_equal(*results)
    assert results[0]["seen"].isna().any() and results[0]["seen"].notna().any()


def test_margin_may_span_chunks(skewed):
    df, _ = skewed
    results = []
    for plan in ({}, {"hot_rows": 50, "chunk_rows": 2}):
        track = tracks(df, **plan).lag("row_ord", "before", 7).lead("row_ord", "after", 5)
        rows = track.rows.select("row_ord", "before", "after").toPandas()
        results.append(rows.sort_values("row_ord").reset_index(drop=True))
    pd.testing.assert_frame_equal(*results)


def test_null_groups_survive_both_plans(spark):
    rows = [(None if i % 3 == 0 else "a", None if i % 2 else 1, float(i % 5), i) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, l int, t double, n long")
    results = []
    for plan in ({}, {"hot_rows": 3, "chunk_rows": 4}, {"hot_rows": 12, "chunk_rows": 4}):
        track = ordered(df, ["k", "l"], ["t", "n"], **plan).lag("n", "before", 6).running(total=("sum", "n"))
        results.append(track.rows.select("n", "pos", "track_rows", "before", "total").toPandas()
                       .sort_values("n").reset_index(drop=True))
    assert len(results[0]) == 60
    for other in results[1:]:
        pd.testing.assert_frame_equal(results[0], other)


@pytest.mark.parametrize("descending", [False, True])
def test_null_and_nan_values_count_at_every_size(spark, descending):
    rows = [(g, v, i + 1) for g in ("a", None) for i, v in enumerate([0.5, None, float("nan"), -1.0, 2.0, 7.0])]
    hist = spark.createDataFrame(rows, "g string, v double, n long")
    results = [
        sorted(map(str, cumulative_by_value(hist, "v", {"n": "before"}, ["g"], descending, rows_per_bucket=size).collect()))
        for size in (1_000, 2)]
    assert results[0] == results[1] and len(results[0]) == 12
    least = "v=nan, n=3, before=0" if descending else "v=None, n=2, before=0"
    assert sum(least in r for r in results[0]) == 2


def test_hash_rank_is_the_global_hash_order(spark):
    units = [f"u{i}" for i in range(300)]
    df = spark.createDataFrame([(u,) for u in units * 2], "u string")
    got = {r.u: (r.rank, r.n_units) for r in hash_rank(df, "u", 42).collect()}
    order = sorted(units, key=lambda u: (hashlib.sha256(f"42:{u}".encode()).hexdigest(), u))
    assert got == {u: (i, 300) for i, u in enumerate(order)}


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 20, 3])
@pytest.mark.parametrize("descending", [False, True])
def test_cumulative_by_value(spark, rows_per_bucket, descending):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({
        "g": rng.choice(["a", "b"], 400, p=[0.9, 0.1]),
        "v": np.round(rng.exponential(size=400), 2), "n": rng.integers(1, 9, 400)})
    frame = frame.groupby(["g", "v"], as_index=False)["n"].sum()
    hist = spark.createDataFrame(frame)
    got = cumulative_by_value(
        hist, "v", {"n": "before"}, ["g"], descending, rows_per_bucket=rows_per_bucket
    ).toPandas().sort_values(["g", "v"]).reset_index(drop=True)
    want = frame.sort_values("v", ascending=not descending)
    want["before"] = want.groupby("g")["n"].cumsum() - want["n"]
    want = want.sort_values(["g", "v"]).reset_index(drop=True)
    assert (got["before"] == want["before"]).all() and len(got) == len(want)


def test_ordered_keeps_all_rows_and_columns(skewed):
    df, frame = skewed
    result = ordered(df, ["video_id"], ["score", "row_ord"], size="n", **HOT).rows
    assert set(result.columns) == {*df.columns, "pos", "n"}
    assert result.count() == len(frame)
