"""Packs: a table that stands for a folder of very many small files."""

import os

import pytest
from pyspark.sql import functions as F

from trackscore.plans import file_queries
from trackscore.sources import files

BOXES = "fold string, video_id string, image_key string, frame_idx long, xc double, yc double, w double, h double"


@pytest.mark.parametrize("name", ["frame_catalog", "label_files", "artifact_listing", "image_copies"])
def test_files_do_not_grow_with_the_images(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(file_queries, "scratch_path", lambda _, label: str(tmp_path / label))
    rows = getattr(file_queries, name)(spark, "/root/testdata/sf0.001").count()
    written = sum(len(names) for _, _, names in os.walk(tmp_path))
    assert rows > 500 and 0 < written < 100


def test_packed_files_are_those_of_the_folder(spark, tmp_path):
    rows = [("train", "v", f"v_{k % 3:05d}", k % 3, k / 64, 0.5, 0.25, 0.25) for k in range(32)]
    boxes = spark.createDataFrame(rows, BOXES)
    boxes = boxes.union(boxes)
    folder, pack = str(tmp_path / "folder"), str(tmp_path / "pack")
    files.write_labels(boxes, folder)
    for _ in range(2):
        files.pack_labels(boxes, pack, lines_per_piece=4)
    pieces = files.read_pack(spark, pack).collect()
    assert max(r.part for r in pieces) == 2
    for name in {r.path for r in pieces}:
        content = b"".join(bytes(r.content) for r in sorted(pieces, key=lambda r: r.part) if r.path == name)
        with open(os.path.join(folder, name), "rb") as file:
            assert content == file.read()
    assert sorted(files.read_labels(spark, pack, packed=True).collect()) == sorted(files.read_labels(spark, folder).collect())
    sizes = {r.path.rsplit("/", 1)[-1]: r.kilobytes for r in files.list_artifacts(spark, folder).collect()}
    assert sizes == {r.path.rsplit("/", 1)[-1]: r.kilobytes for r in files.list_artifacts(spark, pack, packed=True).collect()}


def test_packed_images_are_copied_once(spark, tmp_path):
    source, target = str(tmp_path / "frames"), str(tmp_path / "images")
    frames = spark.createDataFrame([("v/img_00000.jpg", 0, "a"), ("v/img_00000.jpg", 1, "bc"), ("v/img_00001.jpg", 0, "d"), ("v/x.txt", 0, "")],
                                   "path string, part int, content string")
    files.write_pack(frames.withColumn("content", F.col("content").cast("binary")), source)
    assert sorted(r.frame_idx for r in files.frame_catalog(spark, source, packed=True).collect()) == [0, 1]
    boxes = spark.createDataFrame([("val", "v", f"v_{k:05d}", k, 0.5, 0.5, 0.1, 0.1) for k in (0, 0, 1)], BOXES)
    for _ in range(2):
        files.copy_packed_images(spark, boxes, source, target)
    got = {r.path: r.length for r in files.list_pack(spark, target, "*.jpg").collect()}
    assert got == {"val/images/v_00000.jpg": 3, "val/images/v_00001.jpg": 1}
    absent = boxes.limit(1).withColumn("frame_idx", F.lit(7).cast("long")).withColumn("image_key", F.lit("v_00007"))
    with pytest.raises(Exception, match="no frame v/img_00007.jpg"):
        files.copy_packed_images(spark, absent, source, target)
