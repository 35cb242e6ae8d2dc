"""Tracks, sliding windows, gap filling and window assembly.

One shuffle on the track does most of the work. Every track row carries, besides
its own value, the nearest valid value before and after it; a window then picks
among the three by position alone. Windowing and filling are therefore narrow:
no sort or shuffle per window, and nothing is joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import frame_index
from ..functions.draws import normal_draws
from ..schema import TRACK, WINDOW
from .ordering import CHUNK_ROWS, HOT_GROUP_ROWS, Ordered, hash_rank, ordered


def tracks(
    df: DataFrame, hot_rows: int = HOT_GROUP_ROWS, chunk_rows: int = CHUNK_ROWS
) -> Ordered:
    """Order each (video, target) by time; ties keep row order."""
    return ordered(df, TRACK, ["timestamp", "row_ord"], hot_rows=hot_rows, chunk_rows=chunk_rows)


def with_track_position(df: DataFrame, **plan) -> DataFrame:
    """Add ``pos`` (0-based) and ``track_rows``."""
    return tracks(df, **plan).rows


def window_starts(pos: Column, size: Column, seq_len: Column, stride: Column) -> Column:
    """Starts of the windows that hold a position, as an array."""
    low = F.greatest(F.lit(0), F.ceil((pos - seq_len + 1) / stride) * stride).cast("long")
    high = (F.least(F.floor(pos / stride), F.floor((size - seq_len) / stride)) * stride).cast("long")
    return F.when(low <= high, F.sequence(low, high, stride.cast("long")))


def sliding_windows(df: DataFrame, seq_len: int = 16, stride: int = 8) -> DataFrame:
    """One row per (window, position): adds ``start`` and ``i``.

    Starts are 0, stride, 2*stride, ...; a short track gives none and a tail
    shorter than a window is dropped. Each row works out its own windows, so no
    self-join is needed.
    """
    return df.withColumn(
        "start",
        F.explode(window_starts(F.col("pos"), F.col("track_rows"), F.lit(seq_len), F.lit(stride))),
    ).withColumn("i", (F.col("pos") - F.col("start")).cast("int"))


def context_sweep(df: DataFrame, settings: Sequence[tuple[int, int]]) -> DataFrame:
    """Windows for every (seq_len, stride) setting at once; adds both columns."""
    table = F.array(*[
        F.struct(F.lit(length).alias("seq_len"), F.lit(stride).alias("stride"))
        for length, stride in settings
    ])
    swept = df.withColumn("_setting", F.explode(table)).select("*", "_setting.*").drop("_setting")
    return swept.withColumn(
        "start",
        F.explode(window_starts(
            F.col("pos"), F.col("track_rows"), F.col("seq_len"), F.col("stride"))),
    ).withColumn("i", (F.col("pos") - F.col("start")).cast("int"))


def downsample(df: DataFrame, every: int) -> DataFrame:
    """Keep every k-th frame (sampling-rate sweep)."""
    return df.where(frame_index("timestamp") % every == 0)


def with_gap_sources(
    track: Ordered, value: str, seq_len: int = 16, valid: str = "valid"
) -> Ordered:
    """Give each invalid row the nearest valid (pos, value) before and after it.

    Only neighbours inside a window matter, so the frames are bounded by its
    length: cost is linear and a hot track can be cut into chunks with margins.
    """
    candidate = F.when(F.col(valid), F.struct(F.col("pos").alias("at"), F.col(value).alias("v")))
    gap, margin = ~F.col(valid), seq_len - 1
    return track.over_neighbours(
        margin, margin,
        {
            "_before": lambda w: F.when(
                gap, F.last(candidate, ignorenulls=True).over(w.rowsBetween(-margin, 0))),
            "_after": lambda w: F.when(
                gap, F.first(candidate, ignorenulls=True).over(w.rowsBetween(0, margin))),
        },
    )


def fill_gaps(windows: DataFrame, value: str, empty: Column, seq_len: int = 16, valid: str = "valid") -> DataFrame:
    """Fill invalid positions: last valid before, else first valid after, else ``empty``.

    Only positions of the same window count. Adds ``source_pos`` (NULL when
    empty) and ``filled``.
    """
    before = F.col("_before.at") >= F.col("start")
    after = F.col("_after.at") < F.col("start") + seq_len
    own = F.col(valid)
    return windows.withColumns({
        value: F.when(own, F.col(value)).when(before, F.col("_before.v"))
        .when(after, F.col("_after.v")).otherwise(empty),
        "source_pos": F.when(own, F.col("pos")).when(before, F.col("_before.at"))
        .when(after, F.col("_after.at")),
        "filled": ~own,
    }).drop("_before", "_after")


def gap_filled_windows(
    df: DataFrame,
    value: str,
    empty: Column,
    seq_len: int = 16,
    stride: int = 8,
    valid: str = "valid",
    **plan,
) -> DataFrame:
    """Annotation rows with a value to filled windows, in long form."""
    track = with_gap_sources(tracks(df, **plan), value, seq_len, valid)
    return fill_gaps(sliding_windows(track.rows, seq_len, stride), value, empty, seq_len, valid)


def assemble_windows(windows: DataFrame, *columns: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per window with its columns as arrays in position order.

    ``keep`` names columns that are the same in all rows of a window.

    A window has a fixed number of rows, so the arrays are bounded; in the plain
    plan the rows are already together and nothing is shuffled.
    """
    gathered = windows.groupBy(*WINDOW, *keep).agg(
        F.sort_array(F.collect_list(F.struct("i", *columns))).alias("_items")
    )
    return gathered.select(
        *WINDOW, *keep, *[F.col(f"_items.{column}").alias(column) for column in columns]
    )


def add_fill_noise(
    assembled: DataFrame, noise_std: float, seed: int, value: str = "feature"
) -> DataFrame:
    """Add N(0, noise_std) to positions filled from a neighbour.

    ``assembled`` needs ``filled`` and ``source_pos`` beside the vectors. The draw of a
    dimension is that of (seed, video, target, start, noise_std, position, dimension), so it
    depends on neither order nor partitioning; windows without gaps pass through untouched.
    NULL windows and vectors stay NULL.
    """
    if noise_std == 0:
        return assembled
    std = float(noise_std)
    drawn = F.zip_with("filled", "source_pos", lambda f, at: f & at.isNotNull())
    name = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in WINDOW], F.lit(repr(std)))

    def moved(item: Column, i: Column) -> Column:
        draws = normal_draws(F.concat(name, F.lit(":"), i.cast("string")), F.size(item["v"]))
        noisy = F.zip_with(item["v"], draws, lambda x, z: (x + (z * std).cast("float")).cast("float"))
        return F.when(item["at"], noisy).otherwise(item["v"])

    pairs = F.zip_with(value, drawn, lambda v, at: F.struct(v.alias("v"), at.alias("at")))
    changed = F.when(F.exists(drawn, lambda x: x), F.transform(pairs, moved)).otherwise(F.col(value))
    return assembled.withColumn(value, changed)


def attach_features(rows: DataFrame, store: DataFrame, key: str = "key") -> DataFrame:
    """Join features before windowing, so each vector moves once, not once per window.

    A key that the store lacks is an error: a missing vector would drop out of every mean
    unseen. A stored key without a vector keeps NULL, as does a row without a key.
    """
    found = rows.join(store.withColumn("_stored", F.lit(True)), key, "left")
    absent = F.col(key).isNotNull() & F.col("_stored").isNull()
    message = F.concat(F.lit("no stored vector for key "), F.col(key).cast("string"))
    kind = store.schema["feature"].dataType
    return found.withColumn("feature", F.when(absent, F.raise_error(message).cast(kind)).otherwise(F.col("feature"))).drop("_stored")


def pair_negatives(
    df: DataFrame, normal_ids: Sequence[int], seed: int = 42, unit: str = "row_ord"
) -> DataFrame:
    """Give every normal row one row of another action, by seeded hash.

    Negatives are ranked by hash; a normal row picks the rank its own hash
    points at. Picks are uniform, so the join has no hot key.
    """
    is_normal = F.col("action_id").isin(*normal_ids)
    negatives = hash_rank(df.where(~is_normal), unit, seed).withColumnRenamed(unit, "negative_id")
    n_negatives = df.where(~is_normal).count()
    if n_negatives == 0:
        raise ValueError("there is no row of another action to pair with")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(unit).cast("string")), 256)
    pick = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % n_negatives
    normals = df.where(is_normal).select(F.col(unit).alias("normal_id"), pick.alias("rank"))
    return normals.join(negatives.select("negative_id", "rank"), "rank").select(
        "normal_id", "negative_id"
    )


def centered_clips(df: DataFrame, frames: DataFrame, num_frames: int = 8, **plan) -> DataFrame:
    """The frames around each row's time: one output row per clip position.

    ``frames`` holds (video_id, name). The centre is the row's frame number
    limited to the frame list; short clips repeat their last frame. Rows of a
    video without frames keep one row per position with a NULL name.
    """
    listed = ordered(frames, ["video_id"], ["name"], pos="at", size="n_frames", **plan).rows
    sizes = frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_frames"))
    center = F.least(F.greatest(frame_index("timestamp"), F.lit(0)).cast("long"), F.col("n_frames") - 1)
    first = F.greatest(F.lit(0), F.col("_center") - num_frames // 2)
    last = F.least(F.col("_first") + num_frames, F.col("n_frames")) - 1
    wanted = (
        df.select("row_ord", "video_id", "timestamp")
        .join(sizes, "video_id", "left")
        .withColumn("_center", center)
        .withColumn("_first", first)
        .select(
            "row_ord", "video_id", "_first", last.alias("_last"),
            F.explode(F.sequence(F.lit(0), F.lit(num_frames - 1))).alias("i"),
        )
        .select(
            "row_ord", "video_id", "i",
            F.least(F.col("_first") + F.col("i"), F.col("_last")).alias("at"),
        )
    )
    return wanted.join(listed.select("video_id", "at", "name"), ["video_id", "at"], "left").select(
        "row_ord", "video_id", "i", "name"
    )
