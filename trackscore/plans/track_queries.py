"""Queries: feature lookup, tracks, windows, gap filling, scaling, the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as fb
from ..functions import keys as fk
from ..functions.draws import normal_draw_sql
from ..functions.vectors import row_function, zeros
from ..operators import scaling, splits, store, tracks
from ..schema import WINDOW
from ..session import materialize, scratch_path
from ..sources import driver_tables as dt
from .box_queries import KEY_SQL, VIDEO_SPLIT
from .registry import query

SEQ_LEN, STRIDE, DIM = 16, 8, 64
NARROW = ["video_id", "target_id", "timestamp", "row_ord", "valid"]

# The store as the frame-level run leaves it: one row per distinct key of a
# normal-action annotation, with the vector its row points at.
STORE_SQL = f""",
keyed AS (SELECT a.*, {KEY_SQL} AS key FROM annotations a),
store AS (SELECT k.key, arg_min(e.embedding, k.row_ord) AS feature, arg_min(k.valid, k.row_ord) AS valid
  FROM keyed k JOIN embeddings e USING (vec_id) WHERE action_id IN (0,1,2) GROUP BY k.key)
"""


def featured(spark, sf, rows=None):
    """Annotation rows with the vector they point at."""
    rows = dt.annotations(spark, sf) if rows is None else rows
    return tracks.attach_features(rows, dt.features(spark, sf), "vec_id")


def normal_store(spark, sf):
    """The first row of every key names its vector; vectors join last, so none is shuffled per row."""
    rows = fk.with_feature_key(fb.filter_actions(dt.annotations(spark, sf)))
    first = store.first_per_key(rows, ["vec_id", "valid"])
    return first.join(dt.features(spark, sf), "vec_id").select("key", "feature", "valid")


def requested(spark, sf):
    return fk.with_feature_key(dt.annotations(spark, sf)).select("row_ord", "key")


@query("missing_keys", STORE_SQL + "SELECT DISTINCT key FROM keyed ANTI JOIN store USING (key)")
def missing_keys(spark, sf):
    return store.missing_keys(requested(spark, sf), normal_store(spark, sf))


@query("key_difference", STORE_SQL + "SELECT key FROM keyed EXCEPT SELECT key FROM store")
def key_difference(spark, sf):
    return store.key_difference(requested(spark, sf), normal_store(spark, sf))


@query("feature_lookup", STORE_SQL + """
SELECT k.row_ord, k.key, s.valid, round(list_sum(CAST(s.feature AS DOUBLE[])), 6) AS feature_sum
FROM keyed k LEFT JOIN store s USING (key)
""")
def feature_lookup(spark, sf):
    found = store.lookup_features(requested(spark, sf), normal_store(spark, sf))
    total = F.aggregate("feature", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return found.select("row_ord", "key", "valid", F.round(total, 6).alias("feature_sum"))


@query("store_contains", STORE_SQL + """
SELECT DISTINCT k.key, s.key IS NOT NULL AS stored FROM keyed k LEFT JOIN store s USING (key)
""")
def store_contains(spark, sf):
    return store.contains(requested(spark, sf), normal_store(spark, sf))


@query("store_stats", STORE_SQL + """
SELECT count(*) AS n_keys, count(*) FILTER (valid) AS n_valid,
  CAST(max(CASE WHEN valid THEN len(feature) END) AS INT) AS feature_dim FROM store
""")
def store_stats(spark, sf):
    return store.store_stats(normal_store(spark, sf))


@query("store_union", STORE_SQL + """,
rest AS (SELECT k.key, arg_min(k.valid, k.row_ord) AS valid FROM keyed k JOIN embeddings e USING (vec_id)
  WHERE k.key NOT IN (SELECT key FROM store) GROUP BY k.key)
SELECT key, valid FROM store UNION ALL SELECT key, valid FROM rest
""")
def store_union(spark, sf):
    stored = normal_store(spark, sf)
    rows = fk.with_feature_key(dt.annotations(spark, sf)).join(stored.select("key"), "key", "left_anti")
    new = store.first_per_key(rows, ["vec_id", "valid"]).join(dt.features(spark, sf), "vec_id").select(
        "key", "feature", "valid")
    return store.union_store(stored, new).select("key", "valid")


def key_vector(key: str):
    """A stand-in extractor: a vector computed from the key; every 11th frame has none."""
    video, frame, *box = key.split("|")
    if int(frame) % 11 == 0:
        return None
    return [*map(float, box), float(len(video))]


@query("ensure_features", f""",
keyed AS (SELECT a.*, {KEY_SQL} AS key, CAST(trunc(timestamp * 25) AS BIGINT) AS f FROM annotations a)
SELECT row_ord, key, f % 11 <> 0 AS valid,
  CASE WHEN f % 11 <> 0 THEN round(x1 + y1 + x2 + y2 + length(video_id), 4) END AS feature_sum
FROM keyed
""")
def ensure_features(spark, sf):
    """Two rounds over one store: normal rows first, then everything."""
    path = scratch_path(spark, "store")
    signature = fk.store_signature("0" * 64)
    rows = fk.with_feature_key(dt.annotations(spark, sf))
    store.ensure(fb.filter_actions(rows).select("key"), path, signature, key_vector)
    found = store.ensure(rows.select("row_ord", "key"), path, signature, key_vector)
    total = F.aggregate("feature", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return found.select("row_ord", "key", "valid", F.round(total, 4).alias("feature_sum"))


@query("frame_features", f""",
keyed AS (SELECT a.*, {KEY_SQL} AS key, CAST(trunc(timestamp * 25) AS BIGINT) AS f FROM annotations a WHERE action_id IN (0,1,2))
SELECT row_ord, key, round(x1 + y1 + x2 + y2 + length(video_id), 4) AS feature_sum FROM keyed WHERE f % 11 <> 0
""")
def frame_features(spark, sf):
    """Normal rows through the store: extracted once per key, rows without a vector dropped."""
    path, signature = scratch_path(spark, "store"), fk.store_signature("1" * 64)
    found = store.frame_features(dt.annotations(spark, sf), path, signature, key_vector)
    total = F.aggregate("feature", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return found.select("row_ord", "key", F.round(total, 4).alias("feature_sum"))


TRACKS_SQL = """,
t AS (SELECT *, row_number() OVER (PARTITION BY video_id, target_id ORDER BY timestamp, row_ord) - 1 AS pos,
  count(*) OVER (PARTITION BY video_id, target_id) AS n FROM annotations WHERE action_id IN (0,1,2))
"""


def windows_sql(length: int = SEQ_LEN, stride: int = STRIDE) -> str:
    return TRACKS_SQL + f""",
win AS (SELECT t.*, unnest(generate_series(
    greatest(0, CAST(ceil((pos - {length} + 1) / {stride}) AS BIGINT) * {stride}),
    least(pos // {stride}, (n - {length}) // {stride}) * {stride}, {stride})) AS start
  FROM t WHERE n >= {length})
"""


FILLED_SQL = windows_sql() + """,
src AS (SELECT *, pos - start AS i,
  last_value(CASE WHEN valid THEN pos END IGNORE NULLS) OVER (PARTITION BY video_id, target_id, start ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before,
  first_value(CASE WHEN valid THEN pos END IGNORE NULLS) OVER (PARTITION BY video_id, target_id, start ORDER BY pos
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM win),
filled AS (SELECT s.video_id, s.target_id, s.start, CAST(s.i AS INT) AS i, s.pos, NOT s.valid AS filled,
  coalesce(s.before, s.after) AS source_pos, src_row.vec_id AS source_vec
  FROM src s LEFT JOIN t src_row ON s.video_id = src_row.video_id AND s.target_id = src_row.target_id
    AND coalesce(s.before, s.after) = src_row.pos)
"""


def normal_rows(spark, sf):
    return fb.filter_actions(dt.annotations(spark, sf), empty="all")


@query("track_positions", TRACKS_SQL + """
SELECT video_id, target_id, row_ord, pos, n AS track_rows FROM t
""")
def track_positions(spark, sf):
    return tracks.with_track_position(normal_rows(spark, sf)).select(
        "video_id", "target_id", "row_ord", "pos", "track_rows"
    )


@query("sliding_windows", windows_sql() + """
SELECT video_id, target_id, start, CAST(pos - start AS INT) AS i, row_ord FROM win
""")
def sliding_windows(spark, sf):
    rows = tracks.with_track_position(normal_rows(spark, sf))
    return tracks.sliding_windows(rows, SEQ_LEN, STRIDE).select(*WINDOW, "i", "row_ord")


@query("gap_filled_windows", FILLED_SQL + """
SELECT video_id, target_id, start, i, filled, source_pos, source_vec FROM filled
""")
def gap_filled_windows(spark, sf):
    rows = normal_rows(spark, sf)
    filled = tracks.gap_filled_windows(
        rows.drop("x1", "y1", "x2", "y2"), "vec_id", F.lit(None), SEQ_LEN, STRIDE)
    return filled.select(
        *WINDOW, "i", "filled", "source_pos", F.col("vec_id").alias("source_vec"))


def feature_windows(spark, sf, rows=None):
    """Filled windows with their vectors, in long form."""
    rows = normal_rows(spark, sf) if rows is None else rows
    kept = ["video_id", "target_id", "timestamp", "row_ord", "valid", "feature"]
    rows = featured(spark, sf, rows).select(*kept, *[c for c in rows.columns if c == "fold"])
    return tracks.gap_filled_windows(rows, "feature", zeros(DIM), SEQ_LEN, STRIDE)


@query("assembled_windows", FILLED_SQL + """,
x AS (SELECT f.video_id, f.target_id, f.start, f.i, f.filled,
  round(list_sum(CAST(e.embedding AS DOUBLE[])), 6) AS total
  FROM filled f JOIN embeddings e ON e.vec_id = f.source_vec)
SELECT video_id, target_id, start, count(*)::INT AS n_items, count(*) FILTER (filled)::INT AS n_filled,
  round(sum((i + 1) * total), 4) AS ordered_sum FROM x GROUP BY ALL
""")
def assembled_windows(spark, sf):
    whole = tracks.assemble_windows(feature_windows(spark, sf), "feature", "filled")
    total = F.transform("feature", lambda v, i: (i + 1) * F.round(
        F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")), 6))
    return whole.select(
        *WINDOW, F.size("feature").alias("n_items"),
        F.size(F.filter("filled", lambda f: f)).alias("n_filled"),
        F.round(F.aggregate(total, F.lit(0.0), lambda a, x: a + x), 4).alias("ordered_sum"))


NOISE, NOISE_SEED = 0.05, 42


@query("noisy_fill", FILLED_SQL + f""",
gap AS (SELECT f.*, unnest(generate_series(0, {DIM - 1}))::BIGINT AS d, unnest(e.embedding) AS x
  FROM filled f JOIN embeddings e ON e.vec_id = f.source_vec),
val AS (SELECT video_id, target_id, start, i, d, CASE WHEN filled THEN CAST(x + CAST({normal_draw_sql(
    f"'{NOISE_SEED}:' || video_id || ':' || target_id || ':' || start || ':{NOISE!r}:' || i", "d")} * {NOISE}::DOUBLE AS FLOAT) AS FLOAT)
  ELSE x END AS x FROM gap),
tot AS (SELECT video_id, target_id, start, i, round(sum(x::DOUBLE), 5) AS total,
  round(max(x::DOUBLE) FILTER (d = 0), 6) AS first, round(max(x::DOUBLE) FILTER (d = {DIM - 1}), 6) AS last FROM val GROUP BY ALL)
SELECT f.video_id, f.target_id, f.start, f.i, coalesce(first, 0) AS first_dim, coalesce(last, 0) AS last_dim, coalesce(total, 0) AS total
FROM filled f LEFT JOIN tot USING (video_id, target_id, start, i)
""")
def noisy_fill(spark, sf):
    whole = tracks.assemble_windows(
        feature_windows(spark, sf), "feature", "filled", "source_pos")
    noisy = tracks.add_fill_noise(whole, NOISE, NOISE_SEED).select(*WINDOW, F.posexplode("feature").alias("i", "v"))
    total = row_function(lambda x: x.sum(axis=1), "v")
    return noisy.select(
        *WINDOW, "i", F.round(F.col("v")[0].cast("double"), 6).alias("first_dim"),
        F.round(F.element_at("v", -1).cast("double"), 6).alias("last_dim"), F.round(total, 5).alias("total"))


@query("clips", """,
frames AS (SELECT DISTINCT video_id, printf('img_%05d.jpg', CAST(trunc(timestamp * 25) AS BIGINT)) AS name
  FROM annotations WHERE has_frame),
f AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY name) - 1 AS at FROM frames),
s AS (SELECT video_id, count(*) AS n FROM frames GROUP BY ALL),
c AS (SELECT a.row_ord, a.video_id, s.n,
  greatest(0, least(greatest(CAST(trunc(a.timestamp*25) AS BIGINT), 0), s.n - 1) - 4) AS first
  FROM annotations a LEFT JOIN s USING (video_id)),
w AS (SELECT row_ord, video_id, unnest(generate_series(0, 7)) AS i, first, n FROM c)
SELECT w.row_ord, w.video_id, CAST(w.i AS INT) AS i, f.name FROM w LEFT JOIN f
  ON f.video_id = w.video_id AND f.at = least(first + i, least(first + 8, n) - 1)
""")
def clips(spark, sf):
    rows = dt.annotations(spark, sf)
    frames = dt.frames(rows).select(
        "video_id", F.format_string(fk.IMAGE_NAME, "frame_idx").alias("name"))
    return tracks.centered_clips(rows, frames, 8)


@query("negative_pairs", """,
neg AS (SELECT row_ord AS negative_id, row_number() OVER (
  ORDER BY sha256('42:' || CAST(row_ord AS VARCHAR)), row_ord) - 1 AS rank
  FROM annotations WHERE action_id NOT IN (0,1,2)),
nrm AS (SELECT row_ord AS normal_id,
  CAST('0x' || substr(sha256('42:' || CAST(row_ord AS VARCHAR)), 1, 15) AS BIGINT) % (SELECT count(*) FROM neg) AS rank
  FROM annotations WHERE action_id IN (0,1,2))
SELECT normal_id, negative_id FROM nrm JOIN neg USING (rank)
""")
def negative_pairs(spark, sf):
    return tracks.pair_negatives(dt.annotations(spark, sf), [0, 1, 2])


WINDOW_FEATURES_SQL = FILLED_SQL + f""", {VIDEO_SPLIT},
wf AS (SELECT f.video_id, f.target_id, f.start, f.i, s.fold,
  coalesce(e.embedding, list_resize(CAST([] AS FLOAT[]), {DIM}, 0.0::FLOAT)) AS feature
  FROM filled f JOIN split s USING (video_id) LEFT JOIN embeddings e ON e.vec_id = f.source_vec),
el AS (SELECT video_id, target_id, start, i, fold, unnest(generate_series(0, {DIM - 1}))::INT AS dim,
  unnest(feature)::DOUBLE AS x FROM wf),
z AS (SELECT dim, avg(x) AS mean, stddev_pop(x) + 1e-8::DOUBLE AS std FROM el WHERE fold = 'train' GROUP BY dim)
"""


def video_split(spark, sf):
    """The video split, computed once: one row per video, read by every later step."""
    return materialize(splits.grouped_split(dt.annotations(spark, sf), "video_id"))


@query("split_window_counts", windows_sql() + f""", {VIDEO_SPLIT}
SELECT fold, count(DISTINCT (video_id, target_id, start)) AS n_windows, count(*) AS n_rows
FROM win JOIN split USING (video_id) GROUP BY fold
""")
def split_window_counts(spark, sf):
    rows = tracks.with_track_position(normal_rows(spark, sf).select(
        "video_id", "target_id", "timestamp", "row_ord"))
    windows = tracks.sliding_windows(rows, SEQ_LEN, STRIDE)
    split = splits.grouped_split(dt.annotations(spark, sf), "video_id")
    return splits.split_windows(windows, split).groupBy("fold").agg(
        F.count_if(F.col("i") == 0).alias("n_windows"), F.count(F.lit(1)).alias("n_rows"))


def named_windows(spark, sf):
    """Gap-filled windows that name their vectors, with the fold of their video."""
    rows = splits.split_windows(normal_rows(spark, sf), video_split(spark, sf)).select(*NARROW, "vec_id", "fold")
    return tracks.gap_filled_windows(rows, "vec_id", F.lit(None), SEQ_LEN, STRIDE)


@query("zscore_state", WINDOW_FEATURES_SQL + """
SELECT dim, round(mean, 6) AS mean, round(std, 6) AS std FROM z
""")
def zscore_state(spark, sf):
    named = named_windows(spark, sf)
    scaler = scaling.fit_zscore_by_key(scaling.select_fold(named, "train"), dt.features(spark, sf), "vec_id")
    state = [(d, float(m), float(s)) for d, (m, s) in enumerate(zip(scaler.a, scaler.b))]
    return spark.createDataFrame(state, "dim int, mean double, std double").select(
        "dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("zscore_windows", WINDOW_FEATURES_SQL + """
SELECT video_id, target_id, start, dim, round(avg((x - mean) / std), 6) AS mean_z
FROM el JOIN z USING (dim) GROUP BY ALL
""")
def zscore_windows(spark, sf):
    named, vectors = materialize(named_windows(spark, sf)), dt.features(spark, sf).select("vec_id", "feature")
    scaler = scaling.fit_zscore_by_key(scaling.select_fold(named, "train"), vectors, "vec_id")
    # Vectors move whole, once per position, and fold to one row per window before their dimensions become rows.
    # Positions without one stand for zeros.
    rows = named.select(*WINDOW, "i", "vec_id").join(vectors, "vec_id", "left").withColumn(
        "feature", F.coalesce("feature", zeros(DIM)))
    means = tracks.assemble_windows(rows, "feature").select(*WINDOW, scaling.mean_z("feature", scaler).alias("z"))
    return means.select(*WINDOW, F.posexplode("z").alias("dim", "x")).select(
        *WINDOW, "dim", F.round("x", 6).alias("mean_z"))


@query("minmax_state", """
SELECT CAST(dim AS INT) AS dim, round(min(x), 6) AS low, round(max(x), 6) AS high FROM (
  SELECT unnest(generate_series(0, 63)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY dim
""", views=None)
def minmax_state(spark, sf):
    state = scaling.fit_minmax(dt.features(spark, sf))
    return state.select("dim", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


EMBEDDING_SPLIT_SQL = f"""
WITH split_u AS (SELECT vec_id, count(*) OVER () AS n,
  row_number() OVER (ORDER BY sha256('42:' || CAST(vec_id AS VARCHAR)), vec_id) AS rn FROM embeddings),
split AS (SELECT vec_id, CASE WHEN rn - 1 < (20 * n + 99) // 100 THEN 'val' ELSE 'train' END AS fold FROM split_u),
el AS (SELECT vec_id, label, fold, unnest(generate_series(0, {DIM - 1}))::INT AS dim, unnest(embedding)::DOUBLE AS x
  FROM embeddings JOIN split USING (vec_id))"""


@query("minmax_features", EMBEDDING_SPLIT_SQL + """,
st AS (SELECT dim, min(x) AS low, max(x) AS high FROM el WHERE fold = 'train' GROUP BY dim)
SELECT vec_id, dim, round((x - low) / (high - low + 1e-8::DOUBLE), 6) AS x FROM el JOIN st USING (dim)
""", views=None)
def minmax_features(spark, sf):
    rows = dt.features(spark, sf)
    rows = splits.assign_split(rows, splits.grouped_split(rows, "vec_id"), "vec_id")
    scaled = scaling.minmax_fit_apply(rows, "train")
    return scaled.select("vec_id", F.posexplode("feature").alias("dim", "x")).withColumn(
        "x", F.round("x", 6))


@query("window_score", WINDOW_FEATURES_SQL + """
SELECT video_id, target_id, start, fold, round(avg(((x - mean) / std) * ((x - mean) / std)), 6) AS score
FROM el JOIN z USING (dim) GROUP BY ALL
""")
def window_score(spark, sf):
    """Mean squared z-score per window, statistics fitted on train windows.

    No vector is ever shuffled into a window. The fit counts how often the train
    windows use each stored vector and sums the store with those weights; the
    score is computed once per stored vector and only that number is joined to
    rows, ordered, windowed and filled.
    """
    split = video_split(spark, sf)
    rows = splits.split_windows(normal_rows(spark, sf), split).select(*NARROW, "vec_id", "fold")
    vectors = dt.features(spark, sf)
    named = tracks.gap_filled_windows(
        scaling.select_fold(rows, "train"), "vec_id", F.lit(None), SEQ_LEN, STRIDE)
    scaler = scaling.fit_zscore_by_key(named, vectors, "vec_id")
    scores = vectors.select("vec_id", scaling.mean_square_z("feature", scaler).alias("score"))
    scored = rows.join(scores, "vec_id", "left").select(*NARROW, "fold", "score")
    empty = F.lit(scaling.mean_square_z_of_zeros(scaler))
    windows = tracks.gap_filled_windows(scored, "score", empty, SEQ_LEN, STRIDE)
    return windows.groupBy(*WINDOW, "fold").agg(F.round(F.avg("score"), 6).alias("score"))


@query("leakage_check", EMBEDDING_SPLIT_SQL + """,
other AS (SELECT dim, fold, CASE WHEN fold = 'train' THEN x ELSE x * 2 + 100 END AS x FROM el),
f AS (SELECT unnest(['train', 'all']) AS fit_on),
s1 AS (SELECT fit_on, dim, count(*) AS n, min(x) AS low, max(x) AS high, round(avg(x), 9) AS mean
  FROM el, f WHERE fold = fit_on OR fit_on = 'all' GROUP BY ALL),
s2 AS (SELECT fit_on, dim, count(*) AS n, min(x) AS low, max(x) AS high, round(avg(x), 9) AS mean
  FROM other, f WHERE fold = fit_on OR fit_on = 'all' GROUP BY ALL),
moved AS ((SELECT * FROM s1 EXCEPT ALL SELECT * FROM s2) UNION ALL (SELECT * FROM s2 EXCEPT ALL SELECT * FROM s1))
SELECT fit_on, count(dim) AS n_changed FROM f LEFT JOIN moved USING (fit_on) GROUP BY fit_on
""", views=None)
def leakage_check(spark, sf):
    """The fit on training rows must not move when others are perturbed; a fit on all rows does."""
    from ..operators.checks import changed_statistics, rounded_statistics

    rows = dt.features(spark, sf)
    rows = splits.assign_split(rows, splits.grouped_split(rows, "vec_id"), "vec_id")
    parts = [changed_statistics(rows, lambda d, on=on: rounded_statistics(d, on)).select(
        F.lit(on).alias("fit_on"), "n_changed") for on in ("train", "all")]
    return parts[0].unionByName(parts[1])


SWEEP = [(1, 1), (3, 1), (5, 2), (10, 5), (16, 8), (20, 10), (40, 20)]


@query("context_sweep", TRACKS_SQL + """,
p(seq_len, stride) AS (VALUES """ + ", ".join(f"({a}, {b})" for a, b in SWEEP) + """),
w AS (SELECT video_id, target_id, seq_len, stride, ((n - seq_len) // stride) + 1 AS k
  FROM (SELECT DISTINCT video_id, target_id, n FROM t) JOIN p ON n >= seq_len)
SELECT CAST(seq_len AS INT) AS seq_len, CAST(stride AS INT) AS stride, CAST(sum(k) AS BIGINT) AS n_windows,
  CAST(sum(k * seq_len) AS BIGINT) AS n_rows, CAST(sum(stride * k * (k - 1) // 2 * seq_len) AS BIGINT) AS sum_start
FROM w GROUP BY ALL
""")
def context_sweep(spark, sf):
    rows = tracks.with_track_position(normal_rows(spark, sf).select(
        "video_id", "target_id", "timestamp", "row_ord"))
    return tracks.context_sweep(rows, SWEEP).groupBy("seq_len", "stride").agg(
        F.count_if(F.col("i") == 0).alias("n_windows"),
        F.count(F.lit(1)).alias("n_rows"), F.sum("start").alias("sum_start"))


@query("sampling_rate_sweep", "".join([
    TRACKS_SQL.replace("t AS", "unused AS"), """,
k(every) AS (VALUES (1), (2), (5)),
d AS (SELECT every, video_id, target_id, count(*) AS n FROM annotations, k
  WHERE action_id IN (0,1,2) AND CAST(trunc(timestamp * 25) AS BIGINT) % every = 0 GROUP BY ALL)
SELECT CAST(every AS INT) AS every, CAST(sum(greatest(0, (n - 16) // 8 + 1)) AS BIGINT) AS n_windows
FROM d WHERE n >= 16 GROUP BY every
"""]))
def sampling_rate_sweep(spark, sf):
    rows = normal_rows(spark, sf).select("video_id", "target_id", "timestamp", "row_ord")
    result = None
    for every in (1, 2, 5):
        windows = tracks.sliding_windows(
            tracks.with_track_position(tracks.downsample(rows, every)), SEQ_LEN, STRIDE)
        part = windows.where(F.col("i") == 0).groupBy(F.lit(every).alias("every")).agg(
            F.count(F.lit(1)).alias("n_windows"))
        result = part if result is None else result.unionByName(part)
    return result
