"""Box dataset: semi joins against what exists on disk, cleaning, deduplication.

No join here carries a broadcast hint: Spark broadcasts the small side when its
size allows it and falls back to a (skew-split) sort-merge join when not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import (
    clamp_boxes, drop_degenerate, quantize_boxes, to_center_size, with_frame_index,
)
from ..functions.keys import with_image_key

BOX = ["video_id", "frame_idx", "image_key", "xc", "yc", "w", "h"]


def with_known_videos(df: DataFrame, videos: DataFrame) -> DataFrame:
    """Annotations of videos that have a folder."""
    return df.join(videos.select("video_id"), "video_id", "left_semi")


def with_existing_frames(df: DataFrame, frames: DataFrame) -> DataFrame:
    """Annotations whose frame exists; needs ``frame_idx``."""
    return df.join(frames.select("video_id", "frame_idx"), ["video_id", "frame_idx"], "left_semi")


def clean_boxes(df: DataFrame) -> DataFrame:
    """Clamp, drop empty, centre form, quantise: narrow and one codegen stage."""
    return quantize_boxes(to_center_size(drop_degenerate(clamp_boxes(df))))


def distinct_boxes(df: DataFrame) -> DataFrame:
    """The set of boxes per image. Copies fold before the shuffle."""
    return df.select(*BOX).distinct()


def box_dataset(df: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Annotations to the deduplicated box table."""
    rows = with_frame_index(df)
    if frames is not None:
        rows = with_existing_frames(rows, frames)
    return distinct_boxes(with_image_key(clean_boxes(rows)))


def boxes_per_image(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("image_key", "video_id").agg(F.count(F.lit(1)).alias("n_boxes"))


def boxes_per_image_stats(boxes: DataFrame) -> DataFrame:
    """Images, images per video, mean and largest box count."""
    per_video = boxes_per_image(boxes).groupBy("video_id").agg(
        F.count(F.lit(1)).alias("images"), F.sum("n_boxes").alias("boxes"),
        F.max("n_boxes").alias("most"),
    )
    return per_video.agg(
        F.count(F.lit(1)).alias("n_videos"),
        F.sum("images").alias("n_images"),
        F.sum("boxes").alias("n_boxes"),
        F.max("most").alias("max_boxes"),
        F.max("images").alias("max_images_per_video"),
        (F.sum("boxes") / F.sum("images")).alias("mean_boxes"),
    )


def last_box_per_image(df: DataFrame) -> DataFrame:
    """Only the last box of each image by row order (the overwriting writer)."""
    return df.groupBy("image_key").agg(
        F.max_by(F.struct("xc", "yc", "w", "h", "row_ord"), "row_ord").alias("last")
    ).select("image_key", "last.*")


def row_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """Row count after each named stage, as one table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("stage"), "n_rows")
        for name, df in stages.items()
    ]
    result = counts[0]
    for other in counts[1:]:
        result = result.unionByName(other)
    return result


def distinct_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.countDistinct("video_id").alias("n_videos"),
        F.countDistinct("action_id").alias("n_actions"),
    )


def video_ids(df: DataFrame) -> DataFrame:
    return df.select("video_id").distinct()


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.orderBy("row_ord").limit(n)
