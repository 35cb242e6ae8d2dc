"""Quality signals of observations and box-to-track association."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .ordering import CHUNK_ROWS, HOT_GROUP_ROWS, ordered
from .tracks import tracks

GRID = 8
# Up to so many boxes a frame, a box meets all of the other frame: fewer rows than copies for every cell.
SPARSE_FRAME = 32


def quality_signals(df: DataFrame, **plan) -> DataFrame:
    """Box area and aspect, track age, consecutive misses and a missing flag."""
    track = tracks(df, **plan)
    track = track.with_rows(track.rows.withColumn(
        "_seen_at", F.when(F.col("valid"), F.col("pos"))))
    track = track.running(_last_seen=("max", "_seen_at"), _born=("min", "timestamp"))
    width, height = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return track.rows.withColumns({
        "area": width * height,
        "aspect": F.when(height != 0, width / height),
        "age": F.col("timestamp") - F.col("_born"),
        "misses": F.col("pos") - F.coalesce("_last_seen", F.lit(-1)),
        "missing": (~F.col("valid")).cast("int"),
    }).drop("_seen_at", "_last_seen", "_born")


def iou():
    """Overlap of boxes ``a`` and ``b`` (structs of corners)."""
    a, b = F.col("a"), F.col("b")
    wide = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    high = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    shared = F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))
    total = (
        (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - shared)
    return F.when(total > 0, shared / total).otherwise(F.lit(0.0))


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join of large tables, never sent to the driver.

    The size that Spark knows of a checkpointed table is guessed from compressed files; where the
    guess is just below the broadcast limit, the rows are several times that.
    """
    return df.hint("merge")


def overlapping_pairs(
    boxes: DataFrame, min_iou: float, max_gap: int = 1, sparse: int = SPARSE_FRAME, **plan
) -> DataFrame:
    """Pairs (box, next_box, gap, iou) that overlap enough, ``gap`` = 1 .. ``max_gap`` observed frames apart.

    In videos with a frame of more than ``sparse`` boxes they meet only in grid cells both cover,
    and a pair counts in the one cell that holds the corner of its overlap, so boxes far apart are
    never paired and no duplicate removal is needed. In other videos a frame is one cell.
    """
    frames = boxes.groupBy("video_id", "frame_idx").agg(F.count(F.lit(1)).alias("_n"))
    dense = materialize(frames.where(F.col("_n") > sparse).select("video_id").distinct())
    numbered = ordered(frames.drop("_n"), ["video_id"], ["frame_idx"], pos="frame_pos", size="n_frames", **plan).rows
    placed = boxes.join(shuffled(numbered.drop("n_frames")), ["video_id", "frame_idx"])
    if dense.isEmpty():
        placed = placed.withColumn("_dense", F.lit(False))
    else:
        marked = dense.withColumn("_dense", F.lit(True))
        placed = placed.join(shuffled(marked), "video_id", "left").withColumn("_dense", F.coalesce("_dense", F.lit(False)))

    def cells(low: str, high: str):
        covered = F.sequence(F.floor(F.col(low) * GRID), F.floor(F.col(high) * GRID))
        return F.when(F.col("_dense"), covered).otherwise(F.array(F.lit(0).cast("long")))

    gridded = (
        placed.withColumn("_gx", F.explode(cells("x1", "x2")))
        .withColumn("_gy", F.explode(cells("y1", "y2")))
        .select("video_id", "frame_pos", "_gx", "_gy", "_dense", F.struct("box_id", "x1", "y1", "x2", "y2").alias("box"))
    )
    meet = ["video_id", "frame_pos", "_gx", "_gy"]
    left = gridded.withColumnRenamed("box", "a")
    gaps = F.explode(F.sequence(F.lit(1), F.lit(max_gap))).alias("gap")
    right = gridded.drop("_dense").select("*", gaps).withColumn("frame_pos", F.col("frame_pos") - F.col("gap")).withColumnRenamed("box", "b")
    corner_x = F.floor(F.greatest(F.col("a.x1"), F.col("b.x1")) * GRID)
    corner_y = F.floor(F.greatest(F.col("a.y1"), F.col("b.y1")) * GRID)
    return (
        left.join(shuffled(right), meet)
        .where(~F.col("_dense") | ((F.col("_gx") == corner_x) & (F.col("_gy") == corner_y)))
        .select(F.col("a.box_id").alias("box"), F.col("b.box_id").alias("next_box"), "gap", iou().alias("iou"))
        .where(F.col("iou") >= min_iou)
    )


def iou_tracks(
    boxes: DataFrame, min_iou: float = 0.3,
    hot_rows: int = HOT_GROUP_ROWS, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Track per box: boxes of adjacent frames that are each other's best overlap.

    ``boxes`` has (video_id, frame_idx, box_id, corners).
    """
    boxes = materialize(boxes)
    pairs = materialize(overlapping_pairs(boxes, min_iou, hot_rows=hot_rows, chunk_rows=chunk_rows))
    forward = pairs.groupBy("box").agg(
        F.max(F.struct(F.col("iou"), (-F.col("next_box")).alias("n"))).alias("_m")
    ).select("box", (-F.col("_m.n")).alias("next_box"))
    backward = pairs.groupBy("next_box").agg(
        F.max(F.struct(F.col("iou"), (-F.col("box")).alias("n"))).alias("_m")
    ).select("next_box", (-F.col("_m.n")).alias("box"))
    return chained(boxes, forward.join(shuffled(backward), ["box", "next_box"])).select(
        "video_id", "frame_idx", "box_id", "track_id", "age")


def matched_links(pairs: DataFrame) -> DataFrame:
    """One-to-one links (box, next_box, gap, iou): every box has one follower and follows one box at most.

    Shorter gaps go before longer ones, then larger overlaps, then smaller ids. In a round
    each pair that is the best left for both its boxes is taken and the pairs that compete with
    it are dropped; that is what taking all pairs in order, one by one, would choose. A
    round is two shuffles of the pairs that are left.
    """
    best_first = ["gap", F.desc("iou"), "box", "next_box"]
    out, into = Window.partitionBy("box"), Window.partitionBy("next_box")
    path = scratch_path(pairs.sparkSession, "links")
    left = pairs
    while True:
        ranked = left.select("*", F.row_number().over(out.orderBy(*best_first)).alias("_out")).select(
            "*", F.row_number().over(into.orderBy(*best_first)).alias("_in")).withColumn(
            "_taken", (F.col("_out") == 1) & (F.col("_in") == 1))
        ranked = ranked.withColumn("_met", F.max("_taken").over(into)).withColumn("_left", F.max("_taken").over(out))
        state = materialize(ranked)
        state.where("_taken").select(*pairs.columns).write.mode("append").parquet(path)
        left = state.where(~F.col("_met") & ~F.col("_left")).select(*pairs.columns)
        if left.isEmpty():
            return pairs.sparkSession.read.schema(pairs.schema).parquet(path)


def tracked_boxes(
    boxes: DataFrame, min_iou: float = 0.3, max_gap: int = 3,
    hot_rows: int = HOT_GROUP_ROWS, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Track per box, over up to ``max_gap - 1`` missed frames and with one follower per box.

    ``boxes`` has (video_id, frame_idx, box_id, corners). Adds ``track_id`` (the first box),
    ``age`` (boxes before it in the track) and ``gap`` (observed frames since the box before
    it; NULL at the start). Where boxes cross, the larger overlap keeps the link and the
    other box takes its next best, instead of ending its track.
    """
    boxes = materialize(boxes)
    pairs = overlapping_pairs(boxes, min_iou, max_gap, hot_rows=hot_rows, chunk_rows=chunk_rows)
    return chained(boxes, matched_links(materialize(pairs)))


def chained(boxes: DataFrame, links: DataFrame) -> DataFrame:
    """Boxes with the head of their chain of links (``box``, ``next_box``) and their place in it.

    A box has at most one follower, so tracks are chains; each box finds its head by pointer
    doubling, in as many rounds as the longest chain has binary digits. A round joins the
    unresolved boxes, whose pointers are all different, with the (id, pointer, age) of all.
    """
    links = links.select(F.col("next_box").alias("box_id"), F.col("box").alias("pointer"),
                         F.col("gap") if "gap" in links.columns else F.lit(1).alias("gap"))
    links = materialize(links)
    state = materialize(boxes.select("box_id").join(shuffled(links), "box_id", "left").select(
        "box_id",
        F.coalesce("pointer", "box_id").alias("pointer"),
        F.when(F.col("pointer").isNull(), 0).otherwise(1).cast("long").alias("age"),
        F.col("pointer").isNull().alias("done"),
    ))
    # Finished boxes stay where they are; only open ones move on to the next round.
    finished, unfinished = state.where("done"), state.where(~F.col("done"))
    while not unfinished.isEmpty():
        target = finished.unionByName(unfinished).select(
            F.col("box_id").alias("pointer"), F.col("pointer").alias("_next"),
            F.col("age").alias("_age"), F.col("done").alias("_done"))
        moved = materialize(unfinished.join(shuffled(target), "pointer").select(
            "box_id", F.col("_next").alias("pointer"),
            (F.col("age") + F.col("_age")).alias("age"), F.col("_done").alias("done")))
        finished, unfinished = finished.unionByName(moved.where("done")), moved.where(~F.col("done"))
    return boxes.join(
        shuffled(finished.select("box_id", F.col("pointer").alias("track_id"), "age")), "box_id"
    ).join(shuffled(links.select("box_id", "gap")), "box_id", "left").select(
        "video_id", "frame_idx", "box_id", "track_id", "age", "gap")
