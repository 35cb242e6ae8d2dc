"""Files, tables, splits, ledgers and streams."""

import hashlib
import os
from datetime import timedelta

import numpy as np
import pytest
from track_help import FRAMES, extractor
from pyspark.sql import functions as F

from trackscore.config import TrackConfig
from trackscore.functions.boxes import crop_box, with_frame_index
from trackscore.functions.keys import with_feature_key
from trackscore.operators import boxes as ob
from trackscore.operators import events as oe
from trackscore.operators import fingerprint, ledger, splits, store
from trackscore.schema import HISTORY_COLUMNS
from trackscore.sources import files, tables
from trackscore.streaming.events import STORE_PROVIDER, stream_events, tick
from trackscore.streaming.features import start_feature_stream

# A folder with train/ and val/ label files, if there is a real corpus to check.
LABELS = os.environ.get("LABEL_CORPUS", "")


SEEN = (20, 21, 23, 24, 26, 27)


@pytest.fixture
def tree(tmp_path):
    """A folder of one camera: eight boxes that drift right, one inside out, and six frames."""
    (tmp_path / "annotations").mkdir()
    drift = [f"0310,{(20 + k) * 0.04},{0.05 + 0.02 * k:.2f},0.2,{0.45 + 0.02 * k:.2f},0.7,1,4" for k in range(8)]
    (tmp_path / "annotations" / files.PREFERRED_ANNOTATIONS).write_text("\n".join([*drift, "0310,0.8,0.9,0.6,0.7,0.4,1,5"]) + "\n")
    (tmp_path / "annotations" / "a.csv").write_text("x\n")
    frames = tmp_path / "frames" / "0310"
    frames.mkdir(parents=True)
    for frame in SEEN:
        (frames / f"img_{frame:05d}.jpg").write_bytes(bytes([frame]))
    return tmp_path


def test_annotations_to_label_files_and_back(spark, tree):
    source = files.resolve_source(spark, str(tree / "annotations")).first().path
    assert source.endswith(files.PREFERRED_ANNOTATIONS)
    rows = files.read_annotations(spark, source)
    assert rows.first().video_id == "0310" and rows.select("row_ord").distinct().count() == 9
    catalog = files.frame_catalog(spark, str(tree / "frames"))
    assert sorted(r.frame_idx for r in catalog.collect()) == list(SEEN)
    boxes = ob.box_dataset(ob.with_known_videos(rows.union(rows), catalog), catalog)
    assert boxes.count() == 6
    split = splits.grouped_split(boxes, "video_id")
    folded = splits.assign_split(boxes, split)
    out = str(tree / "out")
    files.write_labels(folded, out)
    files.write_labels(folded, out)
    text = (tree / "out" / "val" / "labels" / "0310_00021.txt").read_text()
    assert text == "0 0.270000 0.450000 0.400000 0.500000\n"
    back = files.read_labels(spark, out)
    assert back.count() == 6
    assert back.select("image_key", "xc", "w").exceptAll(boxes.select("image_key", "xc", "w")).isEmpty()
    files.copy_images(spark, folded, str(tree / "frames"), out)
    copied = tree / "out" / "val" / "images" / "0310_00023.jpg"
    assert copied.read_bytes() == bytes([23])
    copied.write_bytes(b"kept")
    files.copy_images(spark, folded, str(tree / "frames"), out)
    assert copied.read_bytes() == b"kept"


def test_inventory_and_artifacts(spark, tree):
    found = {r.directory.rsplit("/", 1)[-1]: r for r in files.directory_inventory(spark, str(tree)).collect()}
    assert found["0310"].n_files == 6
    assert found["0310"].first_names == ["img_00020.jpg", "img_00021.jpg", "img_00023.jpg"]
    (tree / "annotations" / ".hidden").write_text("x")
    assert files.list_artifacts(spark, str(tree / "annotations")).count() == 2


def test_label_corpus(spark):
    if not os.path.isdir(LABELS):
        pytest.skip("the label corpus is not here")
    sizes = {}
    videos = {}
    for split in ("train", "val"):
        rows = files.read_labels(spark, f"{LABELS}/{split}")
        sizes[split] = (rows.select("image_key").distinct().count(), rows.count())
        videos[split] = ob.video_ids(rows)
        assert rows.where("class_id <> 0 or w <= 0 or h <= 0").isEmpty()
    assert sizes == {"train": (764, 2369), "val": (152, 488)}
    assert (videos["train"].count(), videos["val"].count()) == (137, 29)
    assert videos["train"].intersect(videos["val"]).isEmpty()


def test_crop_box_edges(spark):
    cases = [(0.1, 0.1, 0.5, 0.5), (0.5, 0.5, 0.5, 0.5), (1.2, 0.1, 1.5, 0.5), (-0.5, 0.1, -0.2, 0.5), (0.25, 0.0, 0.35, 1.0)]
    df = spark.createDataFrame(cases, "x1 double, y1 double, x2 double, y2 double")
    got = [tuple(r.crop) for r in crop_box(df, 10, 10).collect()]
    assert got == [(1, 1, 5, 5), (5, 5, 6, 6), (9, 1, 10, 5), (0, 1, 1, 5), (2, 0, 4, 10)]
    assert crop_box(df, 0, 0).where("crop is not null").isEmpty()


@pytest.mark.parametrize("n", [1, 2, 5, 11, 491])
def test_split_sizes_and_disjointness(spark, n):
    df = spark.createDataFrame([(str(i),) for i in range(n)], "video_id string")
    split = splits.grouped_split(df.union(df), "video_id")
    assert split.where("fold = 'val'").count() == -(-n // 5) and split.count() == n
    assert splits.split_overlap(split, "video_id").first().n_shared == 0
    three = splits.grouped_split(df, "video_id", {"test": 20, "val": 20})
    assert splits.split_sizes(three).where("fold = 'total'").first().n_items == n
    assert three.where("fold = 'test'").join(split.where("fold = 'train'"), "video_id").isEmpty()
    assert splits.sample_units(df, "video_id").count() == n // 5


def test_fingerprints(spark):
    rows = [("train", "b", 0), ("train", "a", 1), ("val", "c", 2)]
    schema = "fold string, unit string, ordinal int"
    one = spark.createDataFrame(rows, schema)
    turned = spark.createDataFrame([("train", "a", 0), ("train", "b", 1), ("val", "c", 2)], schema)
    moved = spark.createDataFrame([("train", "b", 0), ("val", "a", 1), ("val", "c", 2)], schema)

    def digest(df, by=None):
        row = splits.split_fingerprint(df, "unit", by).first()
        assert row.n_items == 3
        return row.sha256

    assert digest(one) == digest(one.repartition(3)) == digest(turned) != digest(moved)
    assert digest(one, "ordinal") == digest(one.repartition(2), "ordinal") != digest(turned, "ordinal")

    def table(df, by=None):
        return fingerprint.table_fingerprint(df, by).first().sha256

    assert table(one) == table(one.orderBy("unit"))
    assert table(one) != table(one.withColumn("ordinal", F.col("ordinal").cast("long")))
    assert table(one) != table(one.unionByName(one.limit(1)))
    assert table(one) != table(moved)


def test_fields_do_not_run_into_each_other(spark):
    def table(*rows):
        return fingerprint.table_fingerprint(spark.createDataFrame(list(rows), "a string, b string")).first().sha256

    texts = [("a\x1fb", "c"), ("a", "b\x1fc"), ("a", None), ("a", ""), ("a", "\x00"), ("a", "-"), ("1:a", "2"), ("1", ":a2")]
    assert len({table(t) for t in texts}) == len(texts)

    def config(key, value):
        return ledger.config_hash(spark.createDataFrame([("r", key, value)], "run_id string, key string, value string")).first()[1]

    pairs = [("a", "b=c"), ("a=b", "c"), ("a", None), ("a", "")]
    assert len({config(*p) for p in pairs}) == len(pairs)

    def split(fold, unit):
        return splits.split_fingerprint(spark.createDataFrame([(fold, unit)], "fold string, unit string"), "unit").first().sha256

    assert split("a:b", "c") != split("a", "b:c")


def test_frame_numbers_beyond_32_bits(spark):
    df = spark.createDataFrame([(3e9,)], "timestamp double")
    assert with_frame_index(df).first().frame_idx == 75_000_000_000


def test_config_hash_and_diff(spark):
    schema = "run_id string, key string, value string"
    a = spark.createDataFrame([("r", "seed", "42"), ("r", "epochs", "50")], schema)
    b = spark.createDataFrame([("r", "epochs", "50"), ("r", "seed", "42")], schema)
    c = spark.createDataFrame([("r", "epochs", "51"), ("r", "lr", "1")], schema)

    def digest(df):
        return ledger.config_hash(df).first().config_hash

    assert digest(a) == digest(b) != digest(c)
    assert {r.key: r.change for r in ledger.config_diff(a, c, ["run_id"]).collect()} == {
        "seed": "removed", "epochs": "changed", "lr": "added"}
    assert TrackConfig().sha256() == TrackConfig().sha256() != TrackConfig(epochs=1).sha256()


def test_artifacts_are_bound_by_content(spark, tree):
    real, gone = str(tree / "frames" / "0310" / "img_00023.jpg"), str(tree / "nope.pt")
    wanted = spark.createDataFrame([("real", real), ("gone", gone)], "name string, path string")
    got = {r.name: r for r in ledger.artifact_ledger(spark, wanted, str(tree / "frames")).collect()}
    assert got["real"].sha256 == hashlib.sha256(bytes([23])).hexdigest() and got["real"].bytes == 1
    assert got["gone"].missing and got["gone"].sha256 is None


def test_step_verdicts(spark):
    steps = spark.createDataFrame(
        [("r", 6, 1.0, 0, "old", "w1"), ("r", 6, 2.0, 1, "cfg", "w1"), ("r", 7, 1.0, 2, "old", "w1"),
         ("r", 4, 1.0, 3, "cfg", "w2"), ("q", 6, 1.0, 4, "old", "w1")],
        "run_id string, step int, completed_at double, entry_ord long, config_hash string, weights_sha256 string")
    outputs = spark.createDataFrame(
        [("r", 6, True, "w1"), ("r", 7, True, "w1"), ("r", 5, True, "w1"), ("r", 3, False, "w1"),
         ("r", 4, True, "w1"), ("q", 6, True, "w1")],
        "run_id string, step int, output_exists boolean, weights_sha256 string")
    configs = spark.createDataFrame([("r", "cfg"), ("q", None)], "run_id string, config_hash string")
    got = {(r.run_id, r.step): r.verdict for r in ledger.step_verdicts(outputs, steps, configs).collect()}
    assert got == {("r", 6): "reuse", ("r", 7): "stale", ("r", 5): "unverified", ("r", 3): "missing",
                   ("r", 4): "stale", ("q", 6): "reuse"}


@pytest.mark.parametrize("plan", [{}, {"hot_rows": 1, "chunk_rows": 1}])
def test_previous_runs(spark, plan):
    runs = spark.createDataFrame(
        [("d", 1.0, 0, "a"), ("d", 2.0, 1, "a"), ("d", 3.0, 2, "b")],
        "run_id string, started_at double, entry_ord long, config_hash string")
    row = ledger.previous_runs(runs, **plan).collect()
    assert [(r.started_at, r.previous_hash, r.previous_at) for r in row] == [(3.0, "a", 2.0)]


def test_history_and_ledgers(spark, tmp_path):
    history = spark.createDataFrame([(2, *[0.5] * 6), (1, *[1.0] * 6)], ", ".join(
        f"{c} {'int' if c == 'epoch' else 'double'}" for c in HISTORY_COLUMNS))
    path = str(tmp_path / "history")
    tables.write_history(history, path)
    back = spark.read.csv(path, header=True)
    assert back.columns == HISTORY_COLUMNS and [r.epoch for r in back.collect()] == ["1", "2"]
    with pytest.raises(ValueError, match="which it does not have"):
        tables.write_history(history.drop("val_kl"), path)
    entries = spark.createDataFrame([(6, "abc")], "step int, config_hash string")
    where = str(tmp_path / "ledger")
    assert tables.read_ledger(spark, where, entries.schema).isEmpty()
    tables.write_ledger(entries, where)
    tables.write_ledger(entries, where)
    (tmp_path / "ledger" / "bad.json").write_text("{not json\n")
    assert tables.read_ledger(spark, where, entries.schema).count() == 2


def test_feature_stream(spark, annotations, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "store")
    keys = with_feature_key(annotations).select("key")
    keys.limit(3).write.mode("append").parquet(source)

    def drain():
        stream = spark.readStream.schema(keys.schema).parquet(source)
        start_feature_stream(stream, path, "sig", extractor, str(tmp_path / "ck")).awaitTermination()
        return store.read_store(spark, path, "sig").count()

    assert drain() == 3
    keys.write.mode("append").parquet(source)
    assert drain() == 7


def test_feature_stream_drops_repeats_in_state(spark, tmp_path):
    """Repeats of other triggers, before and after a restart, do not reach a batch within the delay; later ones do."""
    source, path, progress = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "progress")
    batches = [
        [("a", 0), ("b", 10), ("a", 20)],
        [("b", 60), ("c", 70)],
        [("a", 90), ("c", 100), ("d", 110)],
        [("e", 1000)],
        [("a", 1010), ("c", 5), (None, 1020)],  # a is new again, c comes too late
    ]

    def run():
        stream = spark.readStream.schema("key string, event_time timestamp").option("maxFilesPerTrigger", 1).parquet(source)
        start_feature_stream(stream, path, "sig", extractor, str(tmp_path / "ck"), "event_time", "200 seconds", progress).awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(progress).where("n_keys > 0").select("batch_id", "n_keys").collect())

    for i, rows in enumerate(batches):
        frame = spark.createDataFrame([(k, float(t)) for k, t in rows], "key string, t double")
        frame.select("key", F.timestamp_seconds("t").alias("event_time")).coalesce(1).write.mode("append").parquet(source)
        if i in (1, 3, 4):
            found = run()
    counts = [n for _, n in found]
    assert counts == [2, 1, 1, 1, 1] and store.read_store(spark, path, "sig").count() == 5
    assert run() == found  # nothing new: nothing changes


def test_stream_events_agree_with_batch(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows, n = [], 0
    for video in ("a", "b"):
        for t in range(60):
            rows.append((video, 0, float(t), n, float(np.round(rng.random(), 2))))
            n += 1
        rows.append((video, 0, 60.0, n, 0.0))
        n += 1
    rows.append(("end", 0, 100_000.0, n, 0.0))
    schema = "video_id string, target_id int, timestamp double, row_ord long, score double"
    df = spark.createDataFrame(rows, schema).withColumn("event_time", F.timestamp_seconds("timestamp"))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.where("timestamp < 30").coalesce(1).write.mode("append").parquet(source)
    df.where("timestamp >= 30").coalesce(1).write.mode("append").parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE_PROVIDER)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream_events(stream, 0.6, 0.3, 1.0, "100 seconds").writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(out).select("video_id", "t_start", "t_end", "peak").collect()))
    batch = oe.extract_events(df.drop("event_time"), 0.6, 0.3, 1.0)
    want = sorted(map(tuple, batch.select("video_id", "t_start", "t_end", "peak").collect()))
    assert got == want and got


def test_silent_tracks_close_over_restarts(spark, tmp_path):
    """Open events close by timers; rows come out of order, in several triggers and runs, some without a score."""
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for video in ("a", "b", "c"):
        at = 0
        for _ in range(150):
            at += int(rng.choice([1, 2, 40], p=[0.6, 0.3, 0.1]))
            score = float(rng.choice([0.1, 0.5, 0.9, np.nan], p=[0.1, 0.3, 0.55, 0.05]))
            rows.append((video, 0, float(at), n, None if rng.random() < 0.05 else score))
            n += 1
    schema = "video_id string, target_id int, timestamp double, row_ord long, score double"
    df = spark.createDataFrame(rows, schema).withColumn("event_time", F.timestamp_seconds("timestamp"))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE_PROVIDER)

    def run():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
        stream_events(stream, 0.6, 0.3, 3.0, "60 seconds", idle=20.0, slot=7.0).writeStream.format("parquet").option(
            "path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

    for low, high in ((0, 120), (120, 400), (400, 10_000)):
        part = df.where(F.col("timestamp").between(low, high - 1))
        # Neighbouring rows change places by less than the delay.
        part.orderBy(F.col("timestamp") + F.col("row_ord") % 30).coalesce(1).write.mode("append").parquet(source)
        run()
    latest = df.agg(F.max("event_time")).first()[0]
    end = [(None, None, None, None, None, tick(latest, timedelta(seconds=60), 20.0, 7.0))]
    spark.createDataFrame(end, df.schema).write.mode("append").parquet(source)
    run()
    columns = ("video_id", "t_start", "t_end", F.nullif("peak", F.lit(float("nan"))).alias("peak"))
    batch = oe.extract_events(df.drop("event_time"), 0.6, 0.3, 3.0, idle=20.0)
    want = sorted(batch.select(*columns).collect(), key=str)
    assert sorted(spark.read.parquet(out).select(*columns).collect(), key=str) == want
    whole = oe.extract_events(df.drop("event_time"), 0.6, 0.3, 3.0)
    assert len(want) > 10 and sorted(whole.select(*columns).collect(), key=str) != want


def test_frame_path_and_preview(spark, annotations):
    row = files.with_frame_path(annotations, "/frames/").orderBy("row_ord").first()
    assert row.path == "/frames/cam7/img_00010.jpg"
    assert [r.row_ord for r in ob.preview(annotations, 2).collect()] == [0, 1]
    assert [r.frame_idx for r in with_frame_index(annotations).orderBy("row_ord").collect()] == list(FRAMES)
