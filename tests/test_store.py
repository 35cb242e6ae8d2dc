"""Incremental store: once-only extraction, invalid rows, errors, signatures."""

import numpy as np
import pytest
from track_help import DIM, FRAMES, MISSING_FRAME, extractor
from pyspark.sql import functions as F

from trackscore.functions.keys import (
    parse_feature_key, seed_from_parts, derive_seed, store_signature, with_feature_key,
)
from trackscore.operators import store

SIGNATURE = store_signature("ab" * 32)


def without_missing(key):
    return None if int(key.split("|")[1]) == MISSING_FRAME else extractor(key)


def counting(path, extract):
    """An extractor that leaves one line per call in a file."""

    def run(key):
        with open(path, "a") as f:
            f.write(key + "\n")
        return extract(key)

    return run


def calls(path):
    try:
        with open(path) as f:
            return f.read().splitlines()
    except FileNotFoundError:
        return []


def test_key_layout(spark):
    df = spark.createDataFrame(
        [("yard", 1.24, 0.15, 0.25, 0.75, 0.5)],
        "video_id string, timestamp double, x1 double, y1 double, x2 double, y2 double")
    keyed = with_feature_key(df)
    assert keyed.first().key == "yard|00031|0.150000|0.250000|0.750000|0.500000"
    back = parse_feature_key(keyed.select("key")).first()
    assert (back.video_id, back.frame_idx, back.x1, back.y2) == ("yard", 31, 0.15, 0.5)


def test_each_key_is_extracted_once(annotations, tmp_path):
    log, path = str(tmp_path / "calls"), str(tmp_path / "store")
    keys = with_feature_key(annotations).select("key")
    keys = keys.union(keys)
    first = store.ensure(keys, path, SIGNATURE, counting(log, extractor))
    assert first.count() == 14 and len(calls(log)) == 7
    again = store.ensure(keys, path, SIGNATURE, counting(log, extractor))
    assert again.count() == 14 and len(calls(log)) == 7
    row = again.where(F.col("key").startswith("cam7|00014")).first()
    np.testing.assert_allclose(row.feature, extractor(row.key), rtol=1e-6)


def test_missing_frames_stay_invalid(annotations, tmp_path):
    log, path = str(tmp_path / "calls"), str(tmp_path / "store")
    keys = with_feature_key(annotations).select("row_ord", "key")
    rows = store.ensure(keys, path, SIGNATURE, counting(log, without_missing)).orderBy("row_ord").collect()
    assert [r.valid for r in rows] == [f != MISSING_FRAME for f in FRAMES]
    assert rows[1].feature is None
    store.ensure(keys, path, SIGNATURE, counting(log, extractor)).collect()
    assert len(calls(log)) == 7
    stats = store.store_stats(store.read_store(annotations.sparkSession, path, SIGNATURE)).first()
    assert (stats.n_keys, stats.n_valid, stats.feature_dim) == (7, 6, DIM)


def test_errors_leave_the_store_alone(annotations, spark, tmp_path):
    path = str(tmp_path / "store")
    keys = with_feature_key(annotations).select("key")
    with pytest.raises(ValueError, match="pass an extractor"):
        store.ensure(keys, path, SIGNATURE)
    with pytest.raises(RuntimeError, match="none of 7 new keys"):
        store.ensure(keys, path, SIGNATURE, lambda key: None)
    assert store.read_store(spark, path, SIGNATURE).isEmpty()
    store.ensure(keys.limit(2), path, SIGNATURE, extractor).collect()
    with pytest.raises(ValueError, match="components"):
        store.ensure(keys, path, SIGNATURE, lambda key: [1.0])
    assert store.read_store(spark, path, SIGNATURE).count() == 2


def test_two_writers_store_a_key_once(annotations, spark, tmp_path, monkeypatch):
    """Another writer publishes between this one's look at the store and its publication; it wins its keys."""
    path = str(tmp_path / "store")
    keys = with_feature_key(annotations).select("key").orderBy("key")
    early, late = keys.limit(4), keys
    publish, others = store.publish, []

    def interrupted(*args):
        if not others:
            others.append(1)
            store.ensure(early, path, SIGNATURE, lambda key: extractor(key) + 1).collect()
        return publish(*args)

    monkeypatch.setattr(store, "publish", interrupted)
    got = store.ensure(late, path, SIGNATURE, extractor).collect()
    assert len(got) == 7 and store.last_batch(spark, path, SIGNATURE) == 2
    won = {r.key for r in early.collect()}
    for row in got:
        np.testing.assert_allclose(row.feature, extractor(row.key) + (row.key in won), rtol=1e-6)
    # The batches that were there at the start are still readable as they were.
    assert store.read_store(spark, path, SIGNATURE, 0).isEmpty() and store.read_store(spark, path, SIGNATURE, 1).count() == 4
    assert list((tmp_path / "store" / "_staging").iterdir()) == []


def test_a_failed_publication_leaves_nothing(annotations, spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    keys = with_feature_key(annotations).select("key")
    store.ensure(keys.limit(3), path, SIGNATURE, extractor).collect()

    def broken(self, source, target):
        raise OSError("the file system went away")

    with monkeypatch.context() as patch:
        patch.setattr(store._Folder, "move", broken)
        with pytest.raises(OSError, match="went away"):
            store.ensure(keys, path, SIGNATURE, extractor)
    assert store.read_store(spark, path, SIGNATURE).count() == 3
    assert list((tmp_path / "store" / "_staging").iterdir()) == []
    # The number is taken: the rename refuses, and the next one is used.
    folder = store._Folder(spark, path)
    assert not folder.move(f"{path}/signature={SIGNATURE}/batch=000000001", f"{path}/signature={SIGNATURE}/batch=000000001")
    assert store.ensure(keys, path, SIGNATURE, extractor).count() == 7
    rows = store.read_store(spark, path, SIGNATURE)
    store.append_store(rows, path)
    assert store.read_store(spark, path, SIGNATURE).count() == 7


def test_other_weights_open_another_store(annotations, spark, tmp_path):
    path = str(tmp_path / "store")
    keys = with_feature_key(annotations).select("key")
    store.ensure(keys, path, SIGNATURE, extractor).collect()
    for other in (store_signature("cd" * 32), store_signature("ab" * 32, layer_index=8),
                  store_signature("ab" * 32, input_size=128)):
        assert other != SIGNATURE
        assert store.read_store(spark, path, other).isEmpty()
    assert store.missing_keys(keys, store.read_store(spark, path, SIGNATURE)).isEmpty()
    assert store.contains(keys, store.read_store(spark, path, SIGNATURE)).where("stored").count() == 7


def test_frame_features_drop_invalid_and_keep_duplicates(annotations, tmp_path):
    rows = annotations.union(annotations)
    got = store.frame_features(rows, str(tmp_path / "s"), SIGNATURE, without_missing)
    assert got.count() == 12
    with pytest.raises(RuntimeError, match="no rows are left"):
        store.frame_features(rows, str(tmp_path / "s"), SIGNATURE, extractor, normal_action_ids=[])


def test_seed_is_stable_and_order_sensitive(spark):
    assert seed_from_parts(42, "v1", 0) == seed_from_parts(42, "v1", 0) != seed_from_parts("v1", 42, 0)
    df = spark.createDataFrame([(42, "v1", 0), (7, "x", 3)], "a long, b string, c long")
    got = [r.s for r in df.select(derive_seed("a", "b", "c").alias("s")).collect()]
    assert got == [seed_from_parts(42, "v1", 0), seed_from_parts(7, "x", 3)]
    assert all(0 <= s < 2**31 - 1 for s in got)
