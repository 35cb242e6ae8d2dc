"""Windows, gap filling, noise and scaling against a plain Python model."""

import hashlib
import math

import numpy as np
import pytest
from track_help import DIM, FRAMES, HOT, MISSING_FRAME, extractor
from pyspark.sql import functions as F

from trackscore.functions.boxes import filter_actions
from trackscore.functions.draws import normal_draws
from trackscore.functions.keys import with_feature_key
from trackscore.functions.vectors import zeros
from trackscore.operators import scaling, store, tracks
from trackscore.sources.tables import read_scaler, write_scaler

SEQ_LEN, STRIDE = 4, 2


@pytest.fixture
def featured(annotations, spark, tmp_path):
    def build(missing=(MISSING_FRAME,)):
        keyed = with_feature_key(annotations)
        return store.ensure(
            keyed, str(tmp_path / f"s{len(missing)}"), "sig",
            lambda k: None if int(k.split("|")[1]) in missing else extractor(k))
    return build


def windows_of(rows, noise=0.0, seed=42):
    filled = tracks.gap_filled_windows(rows, "feature", zeros(DIM), SEQ_LEN, STRIDE)
    whole = tracks.assemble_windows(filled, "feature", "filled", "source_pos")
    return {r.start: np.array(r.feature, dtype=np.float32)
            for r in tracks.add_fill_noise(whole, noise, seed).collect()}


def test_window_starts(annotations):
    got = tracks.sliding_windows(tracks.with_track_position(annotations), SEQ_LEN, STRIDE)
    starts = [(r.start, r.i) for r in got.orderBy("start", "i").collect()]
    assert starts == [(s, i) for s in (0, 2) for i in range(4)]
    none = filter_actions(annotations.withColumn("action_id", F.lit(7)), [0, 1, 2])
    assert tracks.sliding_windows(tracks.with_track_position(none), SEQ_LEN, STRIDE).isEmpty()
    assert filter_actions(annotations, []).count() == 7
    assert filter_actions(annotations, [], empty="none").isEmpty()


def test_gap_is_filled_from_before(featured):
    rows = featured()
    by_pos = {r.row_ord: extractor(r.key) for r in rows.collect()}
    exact = windows_of(rows)
    np.testing.assert_allclose(exact[0], [by_pos[0], by_pos[0], by_pos[2], by_pos[3]], rtol=1e-6)
    np.testing.assert_allclose(exact[2], [by_pos[p] for p in (2, 3, 4, 5)], rtol=1e-6)


def draws_of(key, width):
    out = []
    for block in range(-(-width // 4)):
        digest = hashlib.sha256(f"{key}:{block}".encode()).hexdigest()
        u = [(int(digest[16 * q:16 * q + 13], 16) + 0.5) / 2**52 for q in range(4)]
        for q in (0, 2):
            radius, angle = math.sqrt(-2 * math.log(u[q])), 2 * math.pi * u[q + 1]
            out += [radius * math.cos(angle), radius * math.sin(angle)]
    return out[:width]


def test_draws_are_normal_and_counted_by_place(spark):
    for width in (1, 3, 4, 5, 9):
        got = spark.range(1).select(normal_draws(F.lit("k"), width).alias("d")).first().d
        np.testing.assert_allclose(got, draws_of("k", width), rtol=1e-12)
    rows = spark.range(400).select(F.explode(normal_draws(F.concat(F.lit("k"), "id"), 50)).alias("x"))
    seen = rows.agg(F.avg("x"), F.stddev("x"), F.kurtosis("x"), F.avg((F.abs("x") > 1.959964).cast("int"))).first()
    np.testing.assert_allclose(seen, [0, 1, 0, 0.05], atol=0.07)
    assert abs(seen[3] - 0.05) < 0.006


def test_noise_is_seeded_per_window(featured):
    rows = featured()
    exact, noisy, again = windows_of(rows), windows_of(rows, 0.05), windows_of(rows.repartition(3), 0.05)
    np.testing.assert_array_equal(noisy[0], again[0])
    np.testing.assert_array_equal(noisy[2], exact[2])
    want = exact[0][1] + (np.array(draws_of("42:cam7:2:0:0.05:1", DIM)) * 0.05).astype(np.float32)
    np.testing.assert_allclose(noisy[0][1], want, rtol=1e-6)
    assert not np.array_equal(windows_of(rows, 0.05, seed=1)[0], noisy[0])


def test_a_key_without_stored_vector_is_an_error(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "key string, row_ord int")
    kept = spark.createDataFrame([("a", [1.0]), ("b", None)], "key string, feature array<float>")
    got = {r.row_ord: r.feature for r in tracks.attach_features(rows, kept).collect()}
    assert got == {1: [1.0], 2: None, 3: None}
    with pytest.raises(Exception, match="no stored vector for key b"):
        tracks.attach_features(rows, kept.where("key = 'a'")).collect()


def test_all_invalid_becomes_zeros(featured, annotations):
    rows = annotations.select("*", F.lit(None).cast("array<float>").alias("feature"), F.lit(False).alias("valid"))
    for window in windows_of(rows, 0.05).values():
        np.testing.assert_array_equal(window, np.zeros((SEQ_LEN, DIM)))


def brute_fill(frame, seq_len, stride):
    out = {}
    for video, track in frame.sort_values(["timestamp", "row_ord"]).groupby("video_id"):
        rows, ok = track["row_ord"].tolist(), track["valid"].tolist()
        for start in range(0, len(rows) - seq_len + 1, stride):
            for i in range(seq_len):
                before = [j for j in range(start, start + i + 1) if ok[j]]
                after = [j for j in range(start + i, start + seq_len) if ok[j]]
                source = before[-1] if before else (after[0] if after else None)
                out[video, start, i] = -1 if source is None else rows[source]
    return out


@pytest.mark.parametrize("plan", [{}, HOT])
@pytest.mark.parametrize("seq_len,stride", [(16, 8), (4, 1), (5, 7)])
def test_fill_matches_brute_force(skewed, plan, seq_len, stride):
    df, frame = skewed
    rows = df.withColumn("source", F.col("row_ord"))
    got = tracks.gap_filled_windows(rows, "source", F.lit(-1).cast("long"), seq_len, stride, **plan)
    got = {(r.video_id, r.start, r.i): r.source for r in got.collect()}
    assert got == brute_fill(frame, seq_len, stride)


def test_downsample_and_sweep(skewed):
    df, frame = skewed
    rows = tracks.with_track_position(df)
    swept = tracks.context_sweep(rows, [(16, 8), (3, 1)]).groupBy("seq_len").agg(
        F.count_if(F.col("i") == 0).alias("n")).collect()
    sizes = frame.groupby("video_id").size()
    want = {k: sum(max(0, (n - k) // s + 1) for n in sizes) for k, s in ((16, 8), (3, 1))}
    assert {r.seq_len: r.n for r in swept} == want


def test_scalers(spark, tmp_path):
    data = [([1.0, 2.0], "train"), ([2.0, 4.0], "train"), ([4.0, 0.0], "train"), ([100.0, 100.0], "val")]
    df = spark.createDataFrame(data, "feature array<float>, fold string")
    z = scaling.fit_scaler(df, "zscore")
    x = np.array([[1, 2], [2, 4], [4, 0]], dtype=float)
    np.testing.assert_allclose(z.a, x.mean(0))
    np.testing.assert_allclose(z.b, x.std(0) + 1e-8)
    m = scaling.minmax_fit_apply(df, "train").where("fold = 'train'").collect()
    np.testing.assert_allclose([r.feature for r in m], (x - x.min(0)) / (x.max(0) - x.min(0) + 1e-8))
    assert scaling.fit_scaler(df, "minmax", fit_on="all").b.tolist() == [100.0, 100.0]
    path = str(tmp_path / "scaler")
    write_scaler(z.as_frame(spark), path)
    back = sorted(tuple(r) for r in read_scaler(spark, path).collect())
    assert [r[2] for r in back] == z.a.tolist()


def test_zscore_of_assembled_windows(featured):
    filled = tracks.gap_filled_windows(featured(), "feature", zeros(DIM), SEQ_LEN, STRIDE)
    z = scaling.fit_scaler(filled, "zscore", fit_on="all")
    whole = tracks.assemble_windows(filled, "feature")
    scaled = {r.start: np.array(r.feature) for r in scaling.zscore_apply(whole, z).collect()}
    for r in whole.collect():
        np.testing.assert_allclose(scaled[r.start], (np.array(r.feature) - z.a) / z.b, rtol=1e-5)


def test_pairing_needs_a_negative(annotations):
    with pytest.raises(ValueError, match="another action"):
        tracks.pair_negatives(annotations, [0, 1, 2])


@pytest.mark.parametrize("plan", [{}, {"hot_rows": 3, "chunk_rows": 2}])
def test_centered_clips(spark, plan):
    frames = spark.createDataFrame(
        [("v", f"img_{i:05d}.jpg") for i in range(10)] + [("w", "img_00000.jpg")], "video_id string, name string")
    rows = spark.createDataFrame([(0, "v", 0.2), (1, "v", 9.0), (2, "w", 0.0), (3, "none", 0.0)],
                                 "row_ord long, video_id string, timestamp double")
    got = {}
    for r in tracks.centered_clips(rows, frames, 4, **plan).orderBy("row_ord", "i").collect():
        got.setdefault(r.row_ord, []).append(r.name and int(r.name[4:9]))
    assert got == {0: [3, 4, 5, 6], 1: [7, 8, 9, 9], 2: [0, 0, 0, 0], 3: [None] * 4}


def test_weighted_fit_equals_the_fit_over_windows(featured, annotations):
    rows = featured(missing=FRAMES[:4])
    filled = tracks.gap_filled_windows(rows, "feature", zeros(DIM), SEQ_LEN, 1)
    direct = scaling.fit_scaler(filled, "zscore", fit_on="all")
    named = tracks.gap_filled_windows(
        rows.withColumn("source", F.col("key")), "source", F.lit(None), SEQ_LEN, 1)
    vectors = rows.select(F.col("key").alias("source"), "feature").where("feature is not null").distinct()
    weighted = scaling.fit_zscore_by_key(named, vectors, "source")
    assert named.where("source is null").count() == 4
    np.testing.assert_allclose(weighted.a, direct.a)
    np.testing.assert_allclose(weighted.b, direct.b, rtol=1e-6)
