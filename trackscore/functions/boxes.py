"""Bounding-box column transforms. All stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FPS, NORMAL_ACTIONS

CORNERS = ("x1", "y1", "x2", "y2")


def frame_index(timestamp: Column | str, fps: int = FPS) -> Column:
    """Seconds to frame number, truncated toward zero."""
    column = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    return (column * F.lit(fps)).cast("long")


def with_frame_index(df: DataFrame, fps: int = FPS) -> DataFrame:
    return df.withColumn("frame_idx", frame_index("timestamp", fps))


def filter_actions(
    df: DataFrame, ids: Sequence[int] | None = NORMAL_ACTIONS, empty: str = "all"
) -> DataFrame:
    """Keep rows of the given actions.

    No ids at all means different things to the two pipelines, so the caller
    says which: ``empty="all"`` applies no filter (sequences), ``empty="none"``
    keeps nothing (frame features).
    """
    if empty not in ("all", "none"):
        raise ValueError("empty must be 'all' or 'none'")
    if not ids:
        return df if empty == "all" else df.where(F.lit(False))
    return df.where(F.col("action_id").isin(*[int(i) for i in ids]))


def clamp_boxes(df: DataFrame) -> DataFrame:
    """Limit every corner coordinate to the unit square."""
    return df.withColumns(
        {c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) for c in CORNERS}
    )


def drop_degenerate(df: DataFrame) -> DataFrame:
    """Drop boxes without area; meant to follow ``clamp_boxes``."""
    return df.where((F.col("x1") < F.col("x2")) & (F.col("y1") < F.col("y2")))


def to_center_size(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "xc": (F.col("x1") + F.col("x2")) / F.lit(2.0),
        "yc": (F.col("y1") + F.col("y2")) / F.lit(2.0),
        "w": F.col("x2") - F.col("x1"),
        "h": F.col("y2") - F.col("y1"),
    })


def quantize_boxes(df: DataFrame, places: int = 6) -> DataFrame:
    """Round the centre form, so equal boxes compare equal."""
    return df.withColumns({c: F.round(c, places) for c in ("xc", "yc", "w", "h")})


def to_pixels(df: DataFrame, width: int | str, height: int | str) -> DataFrame:
    """Scale unit coordinates by an image size (numbers or column names)."""
    w, h = _size(width), _size(height)
    return df.withColumns({
        "px1": F.col("x1") * w, "py1": F.col("y1") * h,
        "px2": F.col("x2") * w, "py2": F.col("y2") * h,
    })


def crop_box(df: DataFrame, width: int | str, height: int | str) -> DataFrame:
    """Integer crop of a box: half-even rounding, empty sides widened to a pixel.

    ``crop`` is NULL where no pixel can be cut.
    """
    w, h = _size(width), _size(height)
    left, right, x_ok = _widened(F.rint(F.col("x1") * w), F.rint(F.col("x2") * w), w)
    top, bottom, y_ok = _widened(F.rint(F.col("y1") * h), F.rint(F.col("y2") * h), h)
    return df.withColumn(
        "crop",
        F.when(x_ok & y_ok, F.struct(
            left.cast("int").alias("cx1"), top.cast("int").alias("cy1"),
            right.cast("int").alias("cx2"), bottom.cast("int").alias("cy2"),
        )),
    )


def crop_box_strict(df: DataFrame, width: int | str, height: int | str) -> DataFrame:
    """Integer crop that truncates and drops empty boxes."""
    w, h = _size(width), _size(height)
    zero = F.lit(0)
    return df.withColumns({
        "cx1": F.greatest(zero, (F.col("x1") * w).cast("int")),
        "cy1": F.greatest(zero, (F.col("y1") * h).cast("int")),
        "cx2": F.least(w.cast("int"), (F.col("x2") * w).cast("int")),
        "cy2": F.least(h.cast("int"), (F.col("y2") * h).cast("int")),
    }).where((F.col("cx2") > F.col("cx1")) & (F.col("cy2") > F.col("cy1")))


def _size(value: int | str) -> Column:
    return F.col(value) if isinstance(value, str) else F.lit(value)


def _widened(low: Column, high: Column, size: Column) -> tuple[Column, Column, Column]:
    """One axis of ``crop_box``: clip to the image; an empty side becomes the pixel
    at its start, or the last pixel when the start lies past the border."""
    start, end = F.greatest(F.lit(0.0), low), F.least(size.cast("double"), high)
    empty = end <= start
    past = start + 1 > size
    first = F.when(empty & past, size - 1).otherwise(start)
    last = F.when(empty & past, size).when(empty, start + 1).otherwise(end)
    first, last = F.greatest(F.lit(0.0), first), F.least(size.cast("double"), last)
    return first, last, (size >= 1) & (first < last)
