"""Annotation, frame and label files."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.boxes import frame_index
from ..functions.keys import IMAGE_NAME, video_of_image
from ..schema import ANNOTATION_FILE_SCHEMA

# Fixed value: the preferred annotation file.
PREFERRED_ANNOTATIONS = "ava_train_v2.1.csv"
# Fixed value: one line of a label file, class 0.
LABEL_LINE = "0 %.6f %.6f %.6f %.6f"
# A pack is a table that stands for a folder of very many small files: a row per piece of a file,
# named by its path in the folder. A small file is one piece.
PACK_SCHEMA = "path string, part long, length long, content binary"
LINES_PER_PIECE = 10_000


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Headerless annotation CSV with a file-order column for stable ties.

    ``row_ord`` is unique and grows along a file (splits of one file keep their
    order), so ties in time resolve in file order without a global sort.
    """
    rows = spark.read.schema(ANNOTATION_FILE_SCHEMA).csv(path, header=False)
    return rows.withColumn("row_ord", F.monotonically_increasing_id())


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, size and times of files; contents are pruned from the scan."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
        .select("path", "length", "modificationTime")
    )


def write_pack(pieces: DataFrame, pack: str, mode: str = "append") -> None:
    """Files as (path, part, content) into a pack.

    A folder costs a disk block per file and a listing on the driver with an entry per file; a pack
    costs the bytes, and is listed and read by tasks.
    """
    pieces.select(
        "path", F.col("part").cast("long").alias("part"), F.length("content").cast("long").alias("length"),
        F.col("content").cast("binary").alias("content"),
    ).write.mode(mode).parquet(pack)


def read_pack(spark: SparkSession, pack: str) -> DataFrame:
    """Pieces of a pack; an absent pack is empty."""
    try:
        return spark.read.schema(PACK_SCHEMA).parquet(pack)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], PACK_SCHEMA)


def list_pack(spark: SparkSession, pack: str, pattern: str = "*") -> DataFrame:
    """Path and size of the files of a pack whose name matches; ``*`` stands for any characters."""
    name = ".*".join(re.escape(part) for part in pattern.split("*"))
    found = read_pack(spark, pack).where(F.substring_index("path", "/", -1).rlike(f"^{name}$"))
    return found.groupBy("path").agg(F.sum("length").alias("length"))


def resolve_source(
    spark: SparkSession, path: str, preferred: str = PREFERRED_ANNOTATIONS, pattern: str = "*.csv"
) -> DataFrame:
    """The preferred file if present, else the first match by path (one row)."""
    return list_files(spark, path, pattern).agg(preferred_path(preferred).alias("path"))


def preferred_path(preferred: str) -> Column:
    """Aggregate over ``path``: the file of that name if there is one, else the first path."""
    return F.min_by("path", F.struct(F.substring_index("path", "/", -1) != preferred, F.col("path")))


def frame_catalog(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """Frames in a folder or a pack as (video_id, frame_idx, path)."""
    found = (list_pack if packed else list_files)(spark, path, "img_*.jpg")
    return found.select(
        F.regexp_extract("path", r"([^/]+)/img_\d+\.jpg$", 1).alias("video_id"),
        F.regexp_extract("path", r"img_(\d+)\.jpg$", 1).cast("long").alias("frame_idx"),
        "path",
    )


def directory_inventory(spark: SparkSession, path: str, shown: int = 3) -> DataFrame:
    return inventory_of(list_files(spark, path).select("path"), shown)


def inventory_of(paths: DataFrame, shown: int = 3) -> DataFrame:
    """Per directory: file count and the first names.

    The rank filter is pushed below the shuffle by Spark, so a huge directory
    sends only its first names.
    """
    split = paths.select(
        F.regexp_replace("path", r"/[^/]*$", "").alias("directory"),
        F.substring_index("path", "/", -1).alias("name"),
    )
    counts = split.groupBy("directory").agg(F.count(F.lit(1)).alias("n_files"))
    first = (
        split.withColumn(
            "_rank", F.row_number().over(Window.partitionBy("directory").orderBy("name"))
        )
        .where(F.col("_rank") <= shown)
        .groupBy("directory")
        .agg(F.sort_array(F.collect_list("name")).alias("first_names"))
    )
    return counts.join(first, "directory")


def list_artifacts(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """Artifacts with sizes in KB, sorted by path; hidden names are left out."""
    return (
        (list_pack if packed else list_files)(spark, path)
        .where(~F.substring_index("path", "/", -1).startswith("."))
        .select("path", F.round(F.col("length") / 1024, 1).alias("kilobytes"))
        .orderBy("path")
    )


def label_lines(boxes: DataFrame) -> DataFrame:
    """Distinct label lines as (split, image_key, line)."""
    return boxes.select(
        F.col("fold").alias("split"),
        "image_key",
        F.format_string(LABEL_LINE, "xc", "yc", "w", "h").alias("line"),
    ).distinct()


def write_labels(boxes: DataFrame, directory: str) -> None:
    """One text file per image under ``<split>/labels``; lines sorted.

    Rows of an image arrive sorted in one partition and are streamed, so an
    image with very many boxes needs no memory. A file is written under an
    attempt name and moved, so a retried task leaves no torn file.
    """
    lines = label_lines(boxes)
    lines.repartition("split", "image_key").sortWithinPartitions(
        "split", "image_key", "line"
    ).foreachPartition(lambda rows: _write_groups(rows, directory))


def pack_labels(boxes: DataFrame, pack: str, lines_per_piece: int = LINES_PER_PIECE) -> None:
    """The files of ``write_labels`` as a pack, which replaces the one that is there.

    An image with very many boxes is cut into pieces, so a row stays small.
    """
    image = Window.partitionBy("split", "image_key").orderBy("line")
    lines = label_lines(boxes).withColumn(
        "part", F.floor((F.row_number().over(image) - 1) / F.lit(lines_per_piece)))
    pieces = lines.groupBy("split", "image_key", "part").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    write_pack(pieces.select(
        F.concat("split", F.lit("/labels/"), "image_key", F.lit(".txt")).alias("path"), "part",
        F.concat(F.array_join("lines", "\n"), F.lit("\n")).cast("binary").alias("content")), pack, "overwrite")


def _write_groups(rows: Iterator[Row], directory: str) -> None:
    import itertools
    import uuid

    from pyarrow import fs

    target, root = fs.FileSystem.from_uri(as_uri(directory))
    for (split, image), group in itertools.groupby(rows, key=lambda r: (r.split, r.image_key)):
        folder = posixpath.join(root, split, "labels")
        target.create_dir(folder, recursive=True)
        name = posixpath.join(folder, f"{image}.txt")
        attempt = f"{name}.{uuid.uuid4().hex}"
        with target.open_output_stream(attempt) as out:
            for row in group:
                out.write(f"{row.line}\n".encode())
        target.move(attempt, name)


def read_labels(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """Label files of a folder or a pack back as boxes: one row per line."""
    if packed:
        lines = read_pack(spark, path).where(F.col("path").endswith(".txt")).select(
            "path", F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("value"))
    else:
        lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path).select(
            F.col("_metadata.file_path").alias("path"), "value")
    parts = F.split(F.trim("value"), " ")
    name = F.regexp_extract("path", r"([^/]+)\.txt$", 1)
    return (
        lines.where(F.length(F.trim("value")) > 0)
        .select(
            name.alias("image_key"),
            video_of_image(name).alias("video_id"),
            F.substring_index(name, "_", -1).cast("long").alias("frame_idx"),
            parts[0].cast("int").alias("class_id"),
            *[parts[i + 1].cast("double").alias(c) for i, c in enumerate(["xc", "yc", "w", "h"])],
        )
    )


def copy_plan(boxes: DataFrame, frames_dir: str, directory: str, existing: DataFrame) -> DataFrame:
    """(src, dest) pairs still to copy: one per image, minus destinations present.

    Without the names of the folders the paths are those inside them.
    """
    name = F.format_string(IMAGE_NAME, "frame_idx")
    source, target = (F.lit(folder.rstrip("/") or None).cast("string") for folder in (frames_dir, directory))
    wanted = boxes.select(
        F.concat_ws("/", source, "video_id", name).alias("src"),
        F.concat_ws("/", target, "fold", F.lit("images"),
                    F.concat("image_key", F.lit(".jpg"))).alias("dest"),
    ).distinct()
    return wanted.join(existing, "dest", "left_anti")


def copy_images(spark: SparkSession, boxes: DataFrame, frames_dir: str, directory: str) -> None:
    """Copy each image once; destinations that exist are skipped."""
    from pyarrow import fs

    target, root = fs.FileSystem.from_uri(as_uri(directory))
    if target.get_file_info(root).type == fs.FileType.Directory:
        present = list_files(spark, directory, "*.jpg").select(
            F.regexp_replace("path", r"^file:/*", "/").alias("dest")
        )
        directory = re.sub(r"^file:/*", "/", directory)
    else:
        present = spark.createDataFrame([], "dest string")
    plan = copy_plan(boxes, frames_dir, directory, present)
    plan.repartition("dest").foreachPartition(_copy_rows)


def copy_packed_images(spark: SparkSession, boxes: DataFrame, frames: str, pack: str) -> None:
    """Copy each image once from a pack of frames into another; those that are there are skipped."""
    plan = copy_plan(boxes, "", "", list_pack(spark, pack, "*.jpg").select(F.col("path").alias("dest")))
    found = plan.join(read_pack(spark, frames).withColumnRenamed("path", "src"), "src", "left")
    lost = F.raise_error(F.concat(F.lit("no frame "), "src")).cast("binary")
    write_pack(found.select(
        F.col("dest").alias("path"), "part", F.when(F.col("content").isNull(), lost).otherwise(F.col("content")).alias("content")), pack)


def _copy_rows(rows: Iterator[Row]) -> None:
    import uuid

    from pyarrow import fs

    for row in rows:
        source, src = fs.FileSystem.from_uri(as_uri(row.src))
        target, dest = fs.FileSystem.from_uri(as_uri(row.dest))
        target.create_dir(posixpath.dirname(dest), recursive=True)
        attempt = f"{dest}.{uuid.uuid4().hex}"
        with source.open_input_stream(src) as data, target.open_output_stream(attempt) as out:
            while chunk := data.read(1 << 20):
                out.write(chunk)
        target.move(attempt, dest)


def as_uri(path: str) -> str:
    """A URI that file systems are looked up by; a bare path and ``file:/path`` are local."""
    if path.startswith("file:"):
        return "file:///" + path[5:].lstrip("/")
    return path if "://" in path else f"file://{path}"


def with_frame_path(df: DataFrame, frames_dir: str) -> DataFrame:
    return df.withColumn(
        "path",
        F.concat_ws("/", F.lit(frames_dir.rstrip("/")), "video_id",
                    F.format_string(IMAGE_NAME, frame_index("timestamp"))),
    )
