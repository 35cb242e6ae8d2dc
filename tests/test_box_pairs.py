"""Pairs of overlapping boxes: no broadcast of large tables, few copies of boxes."""

import numpy as np
import pytest

from trackscore.operators import quality


def boxes_of(spark, n_frames, per_frame):
    rng = np.random.default_rng(3)
    rows = []
    for t in range(n_frames):
        for _ in range(per_frame):
            x, y = np.round(rng.uniform(0, 0.6, 2), 2)
            rows.append(("v", t, len(rows), float(x), float(y), float(x) + 0.3, float(y) + 0.4))
    return rows, spark.createDataFrame(
        rows, "video_id string, frame_idx int, box_id long, x1 double, y1 double, x2 double, y2 double")


def test_tracker_broadcasts_nothing(spark):
    """Sizes guessed from compressed files once sent whole tables to the driver."""
    _, boxes = boxes_of(spark, 6, 3)
    for result in (quality.tracked_boxes(boxes, 0.1, 3), quality.iou_tracks(boxes, 0.1), quality.overlapping_pairs(boxes, 0.1, 3)):
        assert "Broadcast" not in result._jdf.queryExecution().executedPlan().toString()


def test_sparse_frames_are_one_cell(spark):
    """A box of a sparse video is not copied into the cells that it covers."""
    _, boxes = boxes_of(spark, 6, 3)
    plan = quality.overlapping_pairs(boxes, 0.1)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(FLOOR" not in plan and "sequence(floor" not in plan


@pytest.mark.parametrize("plan", [{}, {"hot_rows": 3, "chunk_rows": 2}])
@pytest.mark.parametrize("sparse", [0, 3, 4, 100])
def test_pairs_of_sparse_and_dense_videos(spark, plan, sparse):
    rows, boxes = boxes_of(spark, 5, 4)
    rows += [("w", t, 1000 + t, 0.1, 0.1, 0.5, 0.5) for t in range(0, 9, 2)]
    boxes = boxes.union(spark.createDataFrame(rows[-5:], boxes.schema))
    frame = {r[2]: (r[0], r[1] if r[0] == "v" else r[1] // 2) for r in rows}
    want = set()
    for a in rows:
        for b in rows:
            gap = frame[b[2]][1] - frame[a[2]][1]
            if a[0] == b[0] and 1 <= gap <= 2:
                shared = max(min(a[5], b[5]) - max(a[3], b[3]), 0) * max(min(a[6], b[6]) - max(a[4], b[4]), 0)
                total = (a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - shared
                if shared / total >= 0.25:
                    want.add((a[2], b[2], gap))
    got = quality.overlapping_pairs(boxes, 0.25, 2, sparse=sparse, **plan).collect()
    assert {(r.box, r.next_box, r.gap) for r in got} == want and len(got) == len(want)
