"""Queries: annotations to the deduplicated box table, keys, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as fb
from ..functions import keys as fk
from ..operators import boxes as ob
from ..operators import splits
from ..operators.fingerprint import entry_sql
from ..schema import FPS
from ..sources import driver_tables as dt
from ..sources import files
from .registry import query

WIDTH, HEIGHT = 1920, 1080

FRAMES_SQL = """frames AS (
  SELECT DISTINCT video_id, CAST(trunc(timestamp * 25) AS BIGINT) AS frame_idx
  FROM annotations WHERE has_frame)"""

BOXES_SQL = f""", {FRAMES_SQL},
clamped AS (
  SELECT a.video_id, CAST(trunc(a.timestamp * 25) AS BIGINT) AS frame_idx, a.row_ord,
    greatest(0.0::DOUBLE, least(1.0::DOUBLE, x1)) AS x1, greatest(0.0::DOUBLE, least(1.0::DOUBLE, y1)) AS y1,
    greatest(0.0::DOUBLE, least(1.0::DOUBLE, x2)) AS x2, greatest(0.0::DOUBLE, least(1.0::DOUBLE, y2)) AS y2
  FROM annotations a SEMI JOIN frames f
    ON a.video_id = f.video_id AND CAST(trunc(a.timestamp * 25) AS BIGINT) = f.frame_idx),
cleaned AS (
  SELECT video_id, frame_idx, row_ord, printf('%s_%05d', video_id, frame_idx) AS image_key,
    round((x1+x2)/2.0::DOUBLE, 6) AS xc, round((y1+y2)/2.0::DOUBLE, 6) AS yc,
    round(x2-x1, 6) AS w, round(y2-y1, 6) AS h
  FROM clamped WHERE x1 < x2 AND y1 < y2),
boxes AS (SELECT DISTINCT video_id, frame_idx, image_key, xc, yc, w, h FROM cleaned)
"""


def box_table(spark, sf):
    rows = dt.annotations(spark, sf)
    return ob.box_dataset(rows, dt.frames(rows))


@query("annotation_counts", f""", {FRAMES_SQL},
folders AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS video_id FROM labels),
known AS (SELECT * FROM annotations SEMI JOIN folders USING (video_id))
SELECT 'raw' AS stage, count(*) AS n_rows FROM annotations
UNION ALL SELECT 'known_videos', count(*) FROM known
UNION ALL SELECT 'normal_actions', count(*) FROM annotations WHERE action_id IN (0,1,2)
UNION ALL SELECT 'existing_frames', count(*) FROM annotations a SEMI JOIN frames f
  ON a.video_id = f.video_id AND CAST(trunc(a.timestamp * 25) AS BIGINT) = f.frame_idx
""")
def annotation_counts(spark, sf):
    rows = dt.annotations(spark, sf)
    return ob.row_counts({
        "raw": rows,
        "known_videos": ob.with_known_videos(rows, _folders(spark, sf)),
        "normal_actions": fb.filter_actions(rows),
        "existing_frames": ob.with_existing_frames(fb.with_frame_index(rows), dt.frames(rows)),
    })


def _folders(spark, sf):
    """Folder names: documents that carry a label."""
    return dt.table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("video_id")
    ).distinct()


@query("distinct_counts", """
SELECT count(DISTINCT video_id) AS n_videos, count(DISTINCT action_id) AS n_actions FROM annotations
""")
def distinct_counts(spark, sf):
    return ob.distinct_counts(dt.annotations(spark, sf))


@query("preview_rows", """
SELECT video_id, timestamp, x1, y1, x2, y2, action_id, target_id, row_ord
FROM annotations ORDER BY row_ord LIMIT 5
""")
def preview_rows(spark, sf):
    return ob.preview(dt.annotations(spark, sf)).drop("vec_id", "valid", "has_frame")


@query("known_videos", """,
folders AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS video_id FROM labels)
SELECT video_id, row_ord, action_id FROM annotations SEMI JOIN folders USING (video_id)
""")
def known_videos(spark, sf):
    known = ob.with_known_videos(dt.annotations(spark, sf), _folders(spark, sf))
    return known.select("video_id", "row_ord", "action_id")


@query("existing_frames", f""", {FRAMES_SQL}
SELECT a.video_id, f.frame_idx, a.row_ord FROM annotations a JOIN frames f
  ON a.video_id = f.video_id AND CAST(trunc(a.timestamp * 25) AS BIGINT) = f.frame_idx
""")
def existing_frames(spark, sf):
    rows = dt.annotations(spark, sf)
    return ob.with_existing_frames(fb.with_frame_index(rows), dt.frames(rows)).select(
        "video_id", "frame_idx", "row_ord"
    )


@query("action_filter", "SELECT row_ord, action_id FROM annotations WHERE action_id IN (0,1,2)")
def action_filter(spark, sf):
    return fb.filter_actions(dt.annotations(spark, sf)).select("row_ord", "action_id")


@query("frame_index", """
SELECT row_ord, CAST(trunc(timestamp * 25) AS BIGINT) AS frame_idx FROM annotations
""")
def frame_index(spark, sf):
    return fb.with_frame_index(dt.annotations(spark, sf)).select("row_ord", "frame_idx")


@query("clean_boxes", BOXES_SQL + "SELECT video_id, frame_idx, image_key, xc, yc, w, h FROM boxes")
def clean_boxes(spark, sf):
    return box_table(spark, sf)


@query("center_size_boxes", """,
c AS (SELECT row_ord, greatest(0.0::DOUBLE, least(1.0::DOUBLE, x1)) AS x1,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, y1)) AS y1,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, x2)) AS x2,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, y2)) AS y2 FROM annotations)
SELECT row_ord, round((x1+x2)/2.0::DOUBLE, 6) AS xc, round((y1+y2)/2.0::DOUBLE, 6) AS yc,
  round(x2-x1, 6) AS w, round(y2-y1, 6) AS h FROM c WHERE x1 < x2 AND y1 < y2
""")
def center_size_boxes(spark, sf):
    return ob.clean_boxes(dt.annotations(spark, sf)).select("row_ord", "xc", "yc", "w", "h")


@query("pixel_boxes", f"""
SELECT row_ord, round(x1*{WIDTH}, 6) AS px1, round(y1*{HEIGHT}, 6) AS py1,
  round(x2*{WIDTH}, 6) AS px2, round(y2*{HEIGHT}, 6) AS py2 FROM annotations
""")
def pixel_boxes(spark, sf):
    rows = fb.to_pixels(dt.annotations(spark, sf), WIDTH, HEIGHT)
    return rows.select("row_ord", *[F.round(c, 6).alias(c) for c in ("px1", "py1", "px2", "py2")])


@query("crop_boxes", f""",
r AS (SELECT row_ord, greatest(0, round_even(x1*{WIDTH}, 0)) AS a1, least({WIDTH}, round_even(x2*{WIDTH}, 0)) AS a2,
  greatest(0, round_even(y1*{HEIGHT}, 0)) AS b1, least({HEIGHT}, round_even(y2*{HEIGHT}, 0)) AS b2 FROM annotations),
s AS (SELECT row_ord,
  CASE WHEN a2 <= a1 AND a1 + 1 > {WIDTH} THEN {WIDTH} - 1 ELSE a1 END AS cx1,
  CASE WHEN a2 <= a1 AND a1 + 1 > {WIDTH} THEN {WIDTH} WHEN a2 <= a1 THEN a1 + 1 ELSE a2 END AS cx2,
  CASE WHEN b2 <= b1 AND b1 + 1 > {HEIGHT} THEN {HEIGHT} - 1 ELSE b1 END AS cy1,
  CASE WHEN b2 <= b1 AND b1 + 1 > {HEIGHT} THEN {HEIGHT} WHEN b2 <= b1 THEN b1 + 1 ELSE b2 END AS cy2 FROM r)
SELECT row_ord, CAST(cx1 AS INT) AS cx1, CAST(cy1 AS INT) AS cy1, CAST(cx2 AS INT) AS cx2,
  CAST(cy2 AS INT) AS cy2 FROM s
""")
def crop_boxes(spark, sf):
    return fb.crop_box(dt.annotations(spark, sf), WIDTH, HEIGHT).select("row_ord", "crop.*")


@query("crop_boxes_strict", f""",
r AS (SELECT row_ord, greatest(0, CAST(trunc(x1*{WIDTH}) AS INT)) AS cx1,
  greatest(0, CAST(trunc(y1*{HEIGHT}) AS INT)) AS cy1,
  least({WIDTH}, CAST(trunc(x2*{WIDTH}) AS INT)) AS cx2,
  least({HEIGHT}, CAST(trunc(y2*{HEIGHT}) AS INT)) AS cy2 FROM annotations)
SELECT * FROM r WHERE cx2 > cx1 AND cy2 > cy1
""")
def crop_boxes_strict(spark, sf):
    return fb.crop_box_strict(dt.annotations(spark, sf), WIDTH, HEIGHT).select(
        "row_ord", "cx1", "cy1", "cx2", "cy2"
    )


@query("image_keys", BOXES_SQL + """
SELECT image_key, split_part(image_key, '_', 1) AS video_id, count(*) AS n_boxes
FROM boxes GROUP BY ALL
""")
def image_keys(spark, sf):
    boxes = box_table(spark, sf)
    return boxes.groupBy("image_key", fk.video_of_image("image_key").alias("video_id")).agg(
        F.count(F.lit(1)).alias("n_boxes")
    )


@query("normalized_videos", """
SELECT CAST(CAST(lpad(video_id, 6, '0') AS BIGINT) AS VARCHAR) AS video_id, count(*) AS n_rows
FROM annotations GROUP BY ALL
""")
def normalized_videos(spark, sf):
    padded = dt.annotations(spark, sf).withColumn("video_id", F.lpad("video_id", 6, "0"))
    return fk.normalize_video_id(padded).groupBy("video_id").agg(F.count(F.lit(1)).alias("n_rows"))


KEY_SQL = """printf('%s|%05d|%.6f|%.6f|%.6f|%.6f', video_id, CAST(trunc(timestamp * 25) AS BIGINT), x1, y1, x2, y2)"""


@query("feature_keys", f"SELECT row_ord, {KEY_SQL} AS key FROM annotations")
def feature_keys(spark, sf):
    return fk.with_feature_key(dt.annotations(spark, sf)).select("row_ord", "key")


@query("parsed_keys", f""",
k AS (SELECT row_ord, {KEY_SQL} AS key FROM annotations)
SELECT row_ord, split_part(key, '|', 1) AS video_id, CAST(split_part(key, '|', 2) AS BIGINT) AS frame_idx,
  CAST(split_part(key, '|', 3) AS DOUBLE) AS x1, CAST(split_part(key, '|', 4) AS DOUBLE) AS y1,
  CAST(split_part(key, '|', 5) AS DOUBLE) AS x2, CAST(split_part(key, '|', 6) AS DOUBLE) AS y2 FROM k
""")
def parsed_keys(spark, sf):
    keyed = fk.with_feature_key(dt.annotations(spark, sf)).select("row_ord", "key")
    return fk.parse_feature_key(keyed).drop("key")


@query("boxes_per_image", BOXES_SQL + """
SELECT image_key, video_id, count(*) AS n_boxes FROM boxes GROUP BY ALL
""")
def boxes_per_image(spark, sf):
    return ob.boxes_per_image(box_table(spark, sf))


@query("box_stats", BOXES_SQL + """,
per AS (SELECT image_key, video_id, count(*) AS n FROM boxes GROUP BY ALL),
v AS (SELECT video_id, count(*) AS images, sum(n) AS b, max(n) AS m FROM per GROUP BY ALL)
SELECT count(*) AS n_videos, CAST(sum(images) AS BIGINT) AS n_images, CAST(sum(b) AS BIGINT) AS n_boxes,
  max(m) AS max_boxes, max(images) AS max_images_per_video, round(sum(b)::DOUBLE / sum(images)::DOUBLE, 6) AS mean_boxes FROM v
""".replace("\n,\nper", ",\nper"))
def box_stats(spark, sf):
    stats = ob.boxes_per_image_stats(box_table(spark, sf))
    return stats.withColumn("mean_boxes", F.round("mean_boxes", 6))


@query("last_box", BOXES_SQL + """
SELECT image_key, arg_max(xc, row_ord) AS xc, arg_max(yc, row_ord) AS yc, arg_max(w, row_ord) AS w,
  arg_max(h, row_ord) AS h, max(row_ord) AS row_ord FROM cleaned GROUP BY image_key
""")
def last_box(spark, sf):
    rows = fb.with_frame_index(dt.annotations(spark, sf))
    found = ob.with_existing_frames(rows, dt.frames(rows))
    return ob.last_box_per_image(fk.with_image_key(ob.clean_boxes(found)))


@query("video_ids", "SELECT DISTINCT video_id FROM annotations")
def video_ids(spark, sf):
    return ob.video_ids(dt.annotations(spark, sf))


@query("frame_inventory", f""", {FRAMES_SQL},
p AS (SELECT 'frames/' || video_id AS directory, printf('img_%05d.jpg', frame_idx) AS name FROM frames)
SELECT directory, count(*) AS n_files,
  array_to_string(list_slice(list_sort(list(name)), 1, 3), ',') AS first_names FROM p GROUP BY directory
""")
def frame_inventory(spark, sf):
    found = dt.frames(dt.annotations(spark, sf))
    paths = found.select(F.concat_ws(
        "/", F.lit("frames"), "video_id", F.format_string(fk.IMAGE_NAME, "frame_idx")
    ).alias("path"))
    return files.inventory_of(paths).withColumn("first_names", F.array_join("first_names", ","))


def split_sql(unit_cte: str, unit: str, cuts: list[tuple[str, int]], name: str = "split") -> str:
    """The SQL twin of a grouped split (cumulative percents)."""
    whens = " ".join(f"WHEN rn - 1 < ({pct} * n + 99) // 100 THEN '{fold}'" for fold, pct in cuts)
    return f"""{name}_u AS (SELECT DISTINCT {unit} FROM {unit_cte}),
{name}_r AS (SELECT {unit}, count(*) OVER () AS n,
  row_number() OVER (ORDER BY sha256('42:' || CAST({unit} AS VARCHAR)), {unit}) AS rn FROM {name}_u),
{name} AS (SELECT {unit}, CASE {whens} ELSE 'train' END AS fold FROM {name}_r)"""


VIDEO_SPLIT = split_sql("annotations", "video_id", [("val", 20)])
BOX_SPLIT = split_sql("boxes", "video_id", [("val", 20)])


@query("grouped_split", BOXES_SQL + f", {BOX_SPLIT} SELECT video_id, fold FROM split")
def grouped_split(spark, sf):
    return splits.grouped_split(box_table(spark, sf), "video_id")


@query("three_way_split", f""", {split_sql('annotations', 'video_id', [('test', 15), ('val', 35)])}
SELECT video_id, fold FROM split""")
def three_way_split(spark, sf):
    return splits.grouped_split(dt.annotations(spark, sf), "video_id", {"test": 15, "val": 20})


@query("row_split", f""", {split_sql('annotations', 'row_ord', [('val', 20)])}
SELECT row_ord, fold FROM split""")
def row_split(spark, sf):
    return splits.row_split(dt.annotations(spark, sf))


@query("assigned_boxes", BOXES_SQL + f""", {BOX_SPLIT}
SELECT b.image_key, b.xc, b.yc, b.w, b.h, coalesce(s.fold, 'train') AS fold
FROM boxes b LEFT JOIN split s USING (video_id)
""")
def assigned_boxes(spark, sf):
    boxes = box_table(spark, sf)
    split = splits.grouped_split(boxes, "video_id")
    return splits.assign_split(boxes, split).select("image_key", "xc", "yc", "w", "h", "fold")


@query("split_sizes", f""", {VIDEO_SPLIT}
SELECT coalesce(fold, 'total') AS fold, count(*) AS n_items FROM split GROUP BY ROLLUP (fold)
""")
def split_sizes(spark, sf):
    return splits.split_sizes(splits.grouped_split(dt.annotations(spark, sf), "video_id"))


@query("split_overlap", f""", {VIDEO_SPLIT}
SELECT count(*) AS n_shared FROM (
  SELECT video_id FROM split WHERE fold = 'train' INTERSECT SELECT video_id FROM split WHERE fold = 'val')
""")
def split_overlap(spark, sf):
    return splits.split_overlap(
        splits.grouped_split(dt.annotations(spark, sf), "video_id"), "video_id")


FINGERPRINT_SQL = """
e AS (SELECT {keys}sha256({entry}) AS entry, count(*) AS copies FROM {source} GROUP BY ALL),
g AS (SELECT {keys}substr(entry, 1, 6) AS name, sum(copies) AS n,
  sha256(string_agg(entry || 'x' || copies, ',' ORDER BY entry || 'x' || copies)) AS digest FROM e GROUP BY ALL),
h AS (SELECT {keys}substr(name, 1, 3) AS name, sum(n) AS n,
  sha256(string_agg(name || ':' || digest, ',' ORDER BY name || ':' || digest)) AS digest FROM g GROUP BY {keys}substr(name, 1, 3))
SELECT {keys}sha256(string_agg(name || ':' || digest, ',' ORDER BY name || ':' || digest)) AS {digest},
  CAST(sum(n) AS BIGINT) AS {count} FROM h GROUP BY ALL
"""


def fingerprint_sql(entry: str, source: str, keys: str = "", digest: str = "sha256", count: str = "n_items") -> str:
    return FINGERPRINT_SQL.format(entry=entry, source=source, keys=keys, digest=digest, count=count)


@query("split_fingerprint", f""", {VIDEO_SPLIT}, """ + fingerprint_sql(
    entry_sql("fold", "video_id"), "split"))
def split_fingerprint(spark, sf):
    return splits.split_fingerprint(
        splits.grouped_split(dt.annotations(spark, sf), "video_id"), "video_id")


@query("ordered_split_fingerprint", f""", {split_sql('annotations', 'row_ord', [('val', 20)])},
o AS (SELECT s.row_ord, s.fold, a.timestamp FROM split s JOIN annotations a USING (row_ord)), """
       + fingerprint_sql(
    entry_sql("fold", "row_ord", "row_ord"), "o"))
def ordered_split_fingerprint(spark, sf):
    split = splits.row_split(dt.annotations(spark, sf)).withColumn("ordinal", F.col("row_ord"))
    return splits.split_fingerprint(split, "row_ord", ordered_by="ordinal")


@query("sampled_units", """,
u AS (SELECT DISTINCT video_id FROM annotations),
r AS (SELECT video_id, count(*) OVER () AS n,
  row_number() OVER (ORDER BY sha256('42:' || video_id), video_id) AS rn FROM u)
SELECT video_id FROM r WHERE rn - 1 < (20 * n) // 100
""")
def sampled_units(spark, sf):
    return splits.sample_units(dt.annotations(spark, sf), "video_id")


assert FPS == 25  # the SQL above spells the frame rate out
