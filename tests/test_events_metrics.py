"""Events, truth, metrics and associations against brute force, in both plans."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from track_help import HOT
from pyspark.sql import functions as F

from trackscore.functions import corruptions as fc
from trackscore.operators import checks
from trackscore.operators import events as oe
from trackscore.operators import metrics as om
from trackscore.operators import ordering, quality

PLANS = [{}, HOT]
KEY = ["video_id", "target_id"]


def brute_events(frame, hi, lo, least):
    out = []
    for video, track in frame.sort_values(["timestamp", "row_ord"]).groupby("video_id"):
        start = run = end = None
        for t, s in zip(track["timestamp"], track["score"]):
            if s < lo:
                if start is not None:
                    out.append((video, start, end))
                start = run = None
                continue
            run = (t if run is None else run) if s >= hi else None
            if run is not None and t - run >= least and start is None:
                start = run
            end = t
        if start is not None:
            out.append((video, start, end))
    return sorted(out)


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("hi,lo,least", [(0.6, 0.2, 1.0), (0.5, 0.5, 0.0), (0.9, 0.1, 2.0)])
def test_events(skewed, plan, hi, lo, least):
    df, frame = skewed
    got = oe.extract_events(df, hi, lo, least, **plan).collect()
    assert sorted((r.video_id, r.t_start, r.t_end) for r in got) == brute_events(frame, hi, lo, least)
    with pytest.raises(ValueError):
        oe.extract_events(df, 0.1, 0.2, 0)


@pytest.mark.parametrize("plan", PLANS)
def test_truth_runs(skewed, plan):
    df, frame = skewed
    got = oe.truth_manifest(df, **plan).collect()
    want = []
    for video, track in frame.sort_values(["timestamp", "row_ord"]).groupby("video_id"):
        run = (track["action_id"] != track["action_id"].shift()).cumsum()
        for _, g in track.groupby(run):
            want.append((video, g["timestamp"].min(), g["timestamp"].max(), int(g["action_id"].iloc[0]), len(g)))
    assert sorted((r.video_id, r.t_start, r.t_end, r.fold, r.n_rows) for r in got) == sorted(want)


def intervals(spark, rng, n):
    rows = []
    for video in ("hot", "a"):
        edges = np.sort(rng.choice(5000, 2 * (n if video == "hot" else 4), replace=False)).astype(float)
        rows += [(video, 0, b, e, e - b) for b, e in zip(edges[::2].tolist(), edges[1::2].tolist())]
    return spark.createDataFrame(rows, "video_id string, target_id int, t_start double, t_end double, duration double"), rows


@pytest.mark.parametrize("plan", PLANS)
def test_matching_and_delay(spark, plan):
    rng = np.random.default_rng(5)
    truth, truth_rows = intervals(spark, rng, 120)
    events, event_rows = intervals(spark, rng, 90)

    def overlaps(a, b):
        return a[0] == b[0] and a[2] <= b[3] and a[3] >= b[2]

    got = {(r.video_id, r.t_start): r.matched for r in oe.matched(truth, events, KEY, **plan).collect()}
    assert got == {(t[0], t[2]): any(overlaps(t, e) for e in event_rows) for t in truth_rows}
    delays = {(r.video_id, r.t_start): r.delay for r in oe.detection_delay(truth, events, KEY, **plan).collect()}
    for t in truth_rows:
        inside = [e[2] for e in event_rows if e[0] == t[0] and t[2] <= e[2] <= t[3]]
        assert delays[t[0], t[2]] == (min(inside) - t[2] if inside else None)
    observed = spark.createDataFrame([("hot", 86400.0), ("a", 86400.0)], "video_id string, seconds double")
    row = oe.event_metrics(events, truth, observed, KEY, **plan).first()
    assert row.n_truth == len(truth_rows) and row.n_detected == sum(got.values())
    assert row.false_per_day == row.n_false / 2


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"unit": np.arange(400), "positive": rng.random(400) < 0.3})
    frame["a"] = np.round(rng.random(400) + 0.4 * frame["positive"], 2)
    frame["b"] = np.round(rng.random(400) + 0.2 * frame["positive"], 2)
    long = frame.melt(["unit", "positive"], ["a", "b"], "model", "score")
    return spark.createDataFrame(long).persist(), frame


@pytest.fixture(params=[1_000_000, 17])
def buckets(request, monkeypatch):
    """Force the many-bucket plan as well."""
    defaults = list(ordering.cumulative_by_value.__defaults__)
    defaults[-1] = request.param
    monkeypatch.setattr(ordering.cumulative_by_value, "__defaults__", tuple(defaults))


def area(frame, name):
    p, n = frame.loc[frame["positive"], name].to_numpy(), frame.loc[~frame["positive"], name].to_numpy()
    return ((p[:, None] > n).mean() + 0.5 * (p[:, None] == n).mean())


def test_areas_and_thresholds(scored, buckets):
    df, frame = scored
    got = {r.model: r.auroc for r in om.auroc(df, ["model"]).collect()}
    for name in "ab":
        np.testing.assert_allclose(got[name], area(frame, name))
    precision = {r.model: r.auprc for r in om.auprc(df, ["model"]).collect()}
    best = {r.model: (r.threshold, r.f1) for r in om.select_threshold(df, ["model"]).collect()}
    for name in "ab":
        points = []
        for cut in sorted(frame[name].unique()):
            flag = frame[name] >= cut
            tp, fp = (flag & frame["positive"]).sum(), (flag & ~frame["positive"]).sum()
            points.append((2 * tp / (tp + fp + frame["positive"].sum()), cut, tp, fp))
        assert best[name] == (max(points)[1], round(max(points)[0], 9))
        total, before = 0.0, 0
        for _, _, tp, fp in reversed(points):
            total += (tp - before) * tp / (tp + fp)
            before = tp
        np.testing.assert_allclose(precision[name], total / frame["positive"].sum())
    q = {r.model: r.threshold for r in om.quantile_threshold(df, ["model"], 0.9).collect()}
    normal = np.sort(frame.loc[~frame["positive"], "a"])
    assert q["a"] == normal[int(np.ceil(0.9 * len(normal))) - 1]
    rates = om.precision_recall_f1(df, om.select_threshold(df, ["model"]), ["model"]).collect()
    assert all(abs(r.f1 - best[r.model][1]) < 1e-6 for r in rates)


def test_paired_tests(scored, buckets):
    df, frame = scored
    row = om.delong(df, "unit", "a", "b").first()
    place = {}
    for name in "ab":
        p, n = frame.loc[frame["positive"], name].to_numpy(), frame.loc[~frame["positive"], name].to_numpy()
        wins = (p[:, None] > n) + 0.5 * (p[:, None] == n)
        place[name] = (wins.mean(1), wins.mean(0))
    variance = sum(
        np.var(place["a"][k] - place["b"][k], ddof=1) / len(place["a"][k]) for k in (0, 1))
    np.testing.assert_allclose(row.variance, variance)
    np.testing.assert_allclose(row.z, (area(frame, "a") - area(frame, "b")) / np.sqrt(variance))
    assert 0 <= om_p(df, row.z) <= 1
    for z, p in ((0.0, 1.0), (1.959964, 0.05), (-2.575829, 0.01)):
        assert abs(om_p(df, z) - p) < 1e-6
    pairs = df.sparkSession.createDataFrame(frame[["a", "b"]]).withColumns(
        {"a": F.round(F.col("a") * 100), "b": F.round(F.col("b") * 100)})
    test = om.wilcoxon(pairs, "a", "b").first()
    d = np.round(frame["a"] * 100) - np.round(frame["b"] * 100)
    d = d[d != 0]
    rank = d.abs().rank()
    assert test.n_pairs == len(d)
    np.testing.assert_allclose([test.w_plus, test.w_minus], [rank[d > 0].sum(), rank[d < 0].sum()])


@pytest.mark.parametrize("n, ties", [(1, False), (5, False), (5, True), (11, True), (50, False), (51, False)])
def test_wilcoxon_p_is_exact_for_few_pairs(spark, n, ties):
    rng = np.random.default_rng(n)
    d = rng.integers(-4, 5, n) if ties else rng.normal(0.3, 1, n)
    rows = [("g", float(x), 0.0) for x in d] + [("g", 1.0, None), ("g", float("nan"), 0.0), ("same", 2.0, 2.0), ("one", 3.0, 1.0)]
    got = {r.g: r for r in om.wilcoxon(spark.createDataFrame(rows, "g string, a double, b double"), "a", "b", ["g"]).collect()}
    assert set(got) == {"g", "one"} and got["one"].p == 1.0
    d = pd.Series(d[d != 0])
    ranks = (2 * d.abs().rank()).astype(int).tolist()
    if len(d) > om.EXACT_PAIRS:
        assert got["g"].p == om_p(spark.createDataFrame([(1,)], "i int"), got["g"].z)
        return
    chances = Counter({0: 1})
    for r in ranks:  # whole numbers of sign patterns
        chances = Counter({s: chances[s] + chances[s - r] for s in {*chances, *(s + r for s in chances)}})
    small = min(sum(r for r, x in zip(ranks, d) if x > 0), sum(r for r, x in zip(ranks, d) if x < 0))
    want = min(1.0, 2 * sum(c for s, c in chances.items() if s <= small) / 2**len(ranks))
    np.testing.assert_allclose(got["g"].p, want, rtol=1e-12)


def om_p(df, z):
    spark = df.sparkSession
    return spark.createDataFrame([(z,)], "z double").select(om.two_sided_p("z").alias("p")).first().p


def test_pareto(spark, buckets):
    rng = np.random.default_rng(8)
    frame = pd.DataFrame({"id": range(200), "cost": rng.integers(1, 60, 200), "gain": np.round(rng.random(200), 2)})
    got = {r.id for r in om.pareto_front(spark.createDataFrame(frame)).collect()}
    want = set()
    for p in frame.itertuples():
        better = frame[(frame.cost <= p.cost) & (frame.gain >= p.gain) & ((frame.cost < p.cost) | (frame.gain > p.gain))]
        if better.empty:
            want.add(p.id)
    assert got == want


def test_coverage_fails_loudly(spark):
    spec = spark.createDataFrame([("a", 1), ("b", 1)], "model string, seed int")
    assert om.coverage_gaps(spec.limit(1), spec, ["model", "seed"]).count() == 1
    with pytest.raises(ValueError, match="without a result"):
        om.coverage_gaps(spec.where("seed = 2"), spec, ["model", "seed"], fail=True)


@pytest.mark.parametrize("plan", PLANS)
def test_quality_signals(skewed, plan):
    df, frame = skewed
    rows = df.withColumns({"x1": F.lit(0.1), "x2": F.lit(0.5), "y1": F.lit(0.2), "y2": F.lit(0.4)})
    got = {r.row_ord: (r.misses, r.age) for r in quality.quality_signals(rows, **plan).collect()}
    for _, track in frame.sort_values(["timestamp", "row_ord"]).groupby("video_id"):
        misses, born = 0, track["timestamp"].iloc[0]
        for r in track.itertuples():
            misses = 0 if r.valid else misses + 1
            assert got[r.row_ord] == (misses, r.timestamp - born)


@pytest.mark.parametrize("plan", [{}, {"hot_rows": 3, "chunk_rows": 2}])
def test_iou_tracks_follow_a_moving_box(spark, plan):
    rows = []
    for t in range(11):
        rows.append(("v", t, 2 * t, 0.05 * t, 0.1, 0.05 * t + 0.3, 0.4))
        rows.append(("v", t, 2 * t + 1, 0.7, 0.6, 0.9, 0.9))
    rows.append(("v", 11, 99, 0.0, 0.9, 0.05, 1.0))
    boxes = spark.createDataFrame(
        rows, "video_id string, frame_idx int, box_id long, x1 double, y1 double, x2 double, y2 double")
    got = {r.box_id: (r.track_id, r.age) for r in quality.iou_tracks(boxes, 0.3, **plan).collect()}
    want = {2 * t: (0, t) for t in range(11)} | {2 * t + 1: (1, t) for t in range(11)} | {99: (99, 0)}
    assert got == want


def overlap(a, b):
    wide, high = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    shared = max(wide, 0) * max(high, 0)
    total = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared
    return shared / total if total > 0 else 0.0


def brute_tracks(rows, min_iou, max_gap):
    """Links taken one by one, best first: {box: (track, age, gap)}."""
    pos = {}
    for v in {r[0] for r in rows}:
        for at, f in enumerate(sorted({r[1] for r in rows if r[0] == v})):
            pos[v, f] = at
    edges = []
    for a in rows:
        for b in rows:
            gap = pos[b[0], b[1]] - pos[a[0], a[1]]
            if a[0] == b[0] and 1 <= gap <= max_gap and overlap(a[3:], b[3:]) >= min_iou:
                edges.append((gap, -overlap(a[3:], b[3:]), a[2], b[2]))
    follower, before = {}, {}
    for gap, _, a, b in sorted(edges):
        if a not in follower and b not in before:
            follower[a], before[b] = b, (a, gap)
    out = {}
    for r in rows:
        box, age = r[2], 0
        while box in before:
            box, age = before[box][0], age + 1
        out[r[2]] = (box, age, before.get(r[2], (None, None))[1])
    return out


@pytest.mark.parametrize("plan", PLANS)
def test_tracks_survive_missed_frames_and_crossings(spark, plan):
    """Two objects cross; one is missed in some frames, others appear at random."""
    rows, n = [], 0
    for t in range(30):
        left, right = 0.02 * t, 0.6 - 0.02 * t
        boxes = [(left, 0.30, left + 0.2, 0.60), (right, 0.35, right + 0.2, 0.65)]
        for k, box in enumerate(boxes):
            if not (k == 0 and t in (5, 6, 20)):
                rows.append(("v", t, n + k, *box))
        rows.append(("v", t, n + 2, 0.9, 0.9, 1.0, 1.0) if t % 7 else ("v", t, n + 2, 0.9, 0.0, 1.0, 0.1))
        n += 3
    rng = np.random.default_rng(5)
    for t in range(12):
        for _ in range(6):
            x, y = np.round(rng.uniform(0, 0.5, 2), 2)
            rows.append(("w", t, n, float(x), float(y), float(x) + 0.3, float(y) + 0.3))
            n += 1
    boxes = spark.createDataFrame(
        rows, "video_id string, frame_idx int, box_id long, x1 double, y1 double, x2 double, y2 double")
    got = {r.box_id: (r.track_id, r.age, r.gap) for r in quality.tracked_boxes(boxes, 0.3, 3, **plan).collect()}
    assert got == brute_tracks(rows, 0.3, 3)
    # The missed object keeps its track over both gaps; one pass over adjacent frames loses it.
    assert got[3 * 7] == (0, 5, 3) and got[3 * 29][0] == 0
    assert {r.box_id: r.track_id for r in quality.iou_tracks(boxes, 0.3, **plan).collect()}[3 * 7] == 3 * 7
    assert quality.tracked_boxes(boxes.where("false"), **plan).collect() == []


def test_corruptions(spark):
    df = spark.createDataFrame([(1, [0, 1, 2, 3, 4, 5], [9] * 6)], "id int, w array<int>, d array<int>")
    row = df.select(
        fc.reversed_window("w").alias("reversed"), fc.skipped("w", 2).alias("skipped"),
        fc.repeated("w", 3).alias("repeated"), fc.inserted("w", "d", 2).alias("inserted"),
        fc.speed_changed("w", 2.0).alias("fast"), fc.speed_changed("w", 0.5).alias("slow"),
        fc.shuffled("w", 42, "id").alias("mixed")).first()
    assert row.reversed == [5, 4, 3, 2, 1, 0] and row.skipped == [0, 2, 4]
    assert row.repeated == [0, 0, 0, 1, 1, 1] and row.inserted == [0, 1, 9, 9, 9, 9]
    assert row.fast == [0, 2, 4, 5, 5, 5] and row.slow == [0, 0, 1, 1, 2, 2]
    assert sorted(row.mixed) == [0, 1, 2, 3, 4, 5] and row.mixed != [0, 1, 2, 3, 4, 5]


def test_leakage_and_identity(spark):
    rows = [(i, [float(i), 2.0 * i], "train" if i % 3 else "val") for i in range(30)]
    df = spark.createDataFrame(rows, "id int, feature array<float>, fold string")
    assert checks.changed_statistics(df, lambda d: checks.rounded_statistics(d, "train")).first().n_changed == 0
    leaking = checks.changed_statistics(df, lambda d: checks.rounded_statistics(d, "all"))
    assert leaking.first().n_changed > 0
    assert checks.changed_statistics(df.withColumn("fold", F.lit("val")), lambda d: checks.rounded_statistics(d, "val"), fold="val").first().n_changed == 0
    people = spark.createDataFrame([("v", 0, 1), ("v", 0, 1), ("v", 1, 1)], "video_id string, target_id int, frame_idx int")
    assert checks.identity_conflicts(people).first().n_rows == 2
    assert checks.identity_counts(people).first().n_targets == 2
