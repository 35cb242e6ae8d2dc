"""Queries: events, truth, corruptions, quality signals, ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as fb
from ..functions import corruptions as fc
from ..operators import checks, fingerprint, ledger
from ..operators import events as oe
from ..operators import metrics as om
from ..operators import quality, tracks
from ..operators.ordering import hash_rank
from ..schema import TRACK, WINDOW
from ..session import materialize
from ..sources import driver_tables as dt
from .box_queries import fingerprint_sql
from .registry import query
from .track_queries import FILLED_SQL, SEQ_LEN, STRIDE, normal_rows

HI, LO, MIN_DURATION = 70.0, 20.0, 4.0

SCORED_SQL = """,
scored AS (SELECT a.video_id, a.target_id, a.timestamp, a.row_ord, a.action_id, e.value AS score, a.action_id > 2 AS positive
  FROM annotations a JOIN events e ON e.event_id = a.row_ord)"""

EVENTS_SQL = SCORED_SQL + f""",
e1 AS (SELECT *, sum(CASE WHEN score < {LO} THEN 1 ELSE 0 END) OVER w AS stretch,
  sum(CASE WHEN score < {HI} THEN 1 ELSE 0 END) OVER w AS run FROM scored
  WINDOW w AS (PARTITION BY video_id, target_id ORDER BY timestamp, row_ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
e2 AS (SELECT video_id, target_id, stretch, run, min(timestamp) FILTER (score >= {HI}) AS b, max(timestamp) FILTER (score >= {HI}) AS e,
  max(score) FILTER (score >= {HI}) AS top, max(timestamp) AS last FROM e1 WHERE score >= {LO} GROUP BY ALL),
found AS (SELECT video_id, target_id, min(b) FILTER (e - b >= {MIN_DURATION}) AS t_start, max(last) AS t_end,
  max(top) FILTER (e - b >= {MIN_DURATION}) AS peak FROM e2 GROUP BY video_id, target_id, stretch
  HAVING count(*) FILTER (e - b >= {MIN_DURATION}) > 0)"""

TRUTH_SQL = """,
tr1 AS (SELECT *, CASE WHEN lag(action_id) OVER w IS DISTINCT FROM action_id THEN 1 ELSE 0 END AS chg FROM annotations
  WINDOW w AS (PARTITION BY video_id, target_id ORDER BY timestamp, row_ord)),
tr2 AS (SELECT *, sum(chg) OVER (PARTITION BY video_id, target_id ORDER BY timestamp, row_ord
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM tr1),
truth AS (SELECT video_id, target_id AS track_id, min(timestamp) AS t_start, max(timestamp) AS t_end,
  'action_' || any_value(action_id) AS novelty_type, any_value(action_id) AS fold, count(*) AS n_rows
  FROM tr2 GROUP BY video_id, target_id, run),
novel AS (SELECT video_id, track_id AS target_id, t_start, t_end FROM truth WHERE fold = 4)"""


def scored_rows(spark, sf):
    """Annotation rows with the event value as their score."""
    rows = dt.annotations(spark, sf, "value").select(
        *TRACK, "timestamp", "row_ord", "action_id", F.col("value").alias("score"))
    return rows.withColumn("positive", F.col("action_id") > 2)


def event_table(spark, sf):
    return oe.extract_events(scored_rows(spark, sf), HI, LO, MIN_DURATION)


def novel_truth(spark, sf):
    rows = dt.annotations(spark, sf).select(*TRACK, "timestamp", "row_ord", "action_id")
    return oe.truth_manifest(rows).where(F.col("fold") == 4).select(
        "video_id", F.col("track_id").alias("target_id"), "t_start", "t_end")


@query("events", EVENTS_SQL + """
SELECT video_id, target_id, t_start, t_end, peak, round(t_end - t_start, 6) AS duration FROM found
""")
def events(spark, sf):
    return event_table(spark, sf).withColumn("duration", F.round("duration", 6))


@query("truth_manifest", TRUTH_SQL + """
SELECT video_id, track_id, t_start, t_end, novelty_type, fold, n_rows FROM truth
""")
def truth_manifest(spark, sf):
    return oe.truth_manifest(dt.annotations(spark, sf).select(
        *TRACK, "timestamp", "row_ord", "action_id"))


@query("leave_one_out", """,
c AS (SELECT action_id, count(*) AS n FROM annotations GROUP BY ALL), t AS (SELECT count(*) AS total FROM annotations)
SELECT action_id AS fold, n AS held_out, total - n AS retained, round(n::DOUBLE / (total - n)::DOUBLE, 6) AS novelty_ratio FROM c, t
""")
def leave_one_out(spark, sf):
    return oe.leave_one_out(dt.annotations(spark, sf)).withColumn(
        "novelty_ratio", F.round("novelty_ratio", 6))


@query("false_alerts", SCORED_SQL + f""",
c AS (SELECT video_id, count(*) FILTER (score >= {HI} AND NOT positive) AS false_alerts,
  (max(timestamp) - min(timestamp)) / 3600 AS hours FROM scored GROUP BY video_id)
SELECT video_id, false_alerts, round(hours, 6) AS hours, round(false_alerts / hours, 6) AS per_hour,
  round(false_alerts / hours * 24, 6) AS per_day FROM c
""")
def false_alerts(spark, sf):
    flagged = scored_rows(spark, sf).withColumn("flag", F.col("score") >= HI)
    rates = om.false_alert_rate(flagged)
    return rates.withColumns({c: F.round(c, 6) for c in ("hours", "per_hour", "per_day")})


@query("false_event_rates", EVENTS_SQL + TRUTH_SQL + """,
em AS (SELECT video_id, count(*) AS n FROM found f WHERE NOT EXISTS (SELECT 1 FROM novel n WHERE f.video_id = n.video_id
  AND f.target_id = n.target_id AND f.t_start <= n.t_end AND f.t_end >= n.t_start) GROUP BY video_id),
ob AS (SELECT video_id, (max(timestamp) - min(timestamp)) / 3600 AS h FROM scored GROUP BY video_id)
SELECT video_id, coalesce(n, 0) AS false_events, round(h, 6) AS hours, round(coalesce(n, 0) / h, 6) AS per_hour,
  round(coalesce(n, 0) / h * 24, 6) AS per_day FROM ob LEFT JOIN em USING (video_id)
""")
def false_event_rates(spark, sf):
    """Alerts counted on events."""
    observed = scored_rows(spark, sf).groupBy("video_id").agg(
        (F.max("timestamp") - F.min("timestamp")).alias("seconds"))
    events_ = oe.matched(materialize(event_table(spark, sf)), novel_truth(spark, sf), TRACK)
    rates = om.false_event_rate(events_, observed)
    return rates.withColumns({c: F.round(c, 6) for c in ("hours", "per_hour", "per_day")})


@query("loo_folds", """
SELECT f.fold, row_ord, CASE WHEN action_id = f.fold THEN 'test' ELSE 'train' END AS part
FROM annotations, (SELECT DISTINCT action_id AS fold FROM annotations) f
""")
def loo_folds(spark, sf):
    """Every row's part in every leave-one-action-out fold."""
    return oe.loo_folds(dt.annotations(spark, sf)).select("fold", "row_ord", "part")


@query("detection_delay", EVENTS_SQL + TRUTH_SQL + """
SELECT n.video_id, n.target_id, n.t_start, n.t_end,
  round((SELECT min(f.t_start) FROM found f WHERE f.video_id = n.video_id AND f.target_id = n.target_id
    AND f.t_start >= n.t_start AND f.t_start <= n.t_end) - n.t_start, 6) AS delay FROM novel n
""")
def detection_delay(spark, sf):
    return oe.detection_delay(novel_truth(spark, sf), event_table(spark, sf), TRACK).withColumn(
        "delay", F.round("delay", 6))


@query("event_metrics", EVENTS_SQL + TRUTH_SQL + """,
tm AS (SELECT n.*, EXISTS (SELECT 1 FROM found f WHERE f.video_id = n.video_id AND f.target_id = n.target_id
  AND f.t_start <= n.t_end AND f.t_end >= n.t_start) AS hit FROM novel n),
em AS (SELECT f.*, EXISTS (SELECT 1 FROM novel n WHERE f.video_id = n.video_id AND f.target_id = n.target_id
  AND f.t_start <= n.t_end AND f.t_end >= n.t_start) AS hit FROM found f),
ob AS (SELECT sum(s) / 86400 AS days FROM (SELECT max(timestamp) - min(timestamp) AS s FROM scored GROUP BY video_id)),
a AS (SELECT count(*) AS n_truth, count(*) FILTER (hit) AS n_detected FROM tm),
b AS (SELECT count(*) AS n_events, count(*) FILTER (NOT hit) AS n_false, avg(t_end - t_start) AS mean_duration FROM em)
SELECT n_truth, n_detected, n_events, n_false, round(mean_duration, 6) AS mean_duration, round(days, 6) AS days,
  round(n_detected::DOUBLE / n_truth::DOUBLE, 6) AS detection_rate, round(n_false / days, 6) AS false_per_day FROM a, b, ob
""")
def event_metrics(spark, sf):
    rows = scored_rows(spark, sf)
    observed = rows.groupBy("video_id").agg(
        (F.max("timestamp") - F.min("timestamp")).alias("seconds"))
    result = oe.event_metrics(
        event_table(spark, sf), novel_truth(spark, sf), observed, TRACK)
    return result.withColumns({
        c: F.round(c, 6) for c in ("mean_duration", "days", "detection_rate", "false_per_day")})


@query("quality_signals", """,
q AS (SELECT *, row_number() OVER w - 1 AS pos, min(timestamp) OVER w AS born,
  max(CASE WHEN valid THEN row_number_ END) OVER w AS seen FROM (
    SELECT *, row_number() OVER (PARTITION BY video_id, target_id ORDER BY timestamp, row_ord) - 1 AS row_number_ FROM annotations)
  WINDOW w AS (PARTITION BY video_id, target_id ORDER BY timestamp, row_ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT row_ord, round((x2-x1)*(y2-y1), 6) AS area, CASE WHEN y2-y1 <> 0 THEN round((x2-x1)/(y2-y1), 6) END AS aspect,
  round(timestamp - born, 6) AS age, pos - coalesce(seen, -1) AS misses, CAST(NOT valid AS INT) AS missing FROM q
""")
def quality_signals(spark, sf):
    rows = dt.annotations(spark, sf).select(
        *TRACK, "timestamp", "row_ord", "x1", "y1", "x2", "y2", "valid")
    return quality.quality_signals(rows).select(
        "row_ord", *[F.round(c, 6).alias(c) for c in ("area", "aspect", "age")], "misses", "missing")


@query("identity_checks", """
SELECT video_id, target_id, CAST(trunc(timestamp * 25) AS BIGINT) AS frame_idx, count(*) AS n_rows
FROM annotations GROUP BY ALL HAVING count(*) > 1
""")
def identity_checks(spark, sf):
    return checks.identity_conflicts(fb.with_frame_index(dt.annotations(spark, sf)))


@query("identity_counts", "SELECT video_id, count(DISTINCT target_id) AS n_targets FROM annotations GROUP BY video_id")
def identity_counts(spark, sf):
    return checks.identity_counts(dt.annotations(spark, sf))


MIN_IOU = 0.1


BOXES_SQL = """,
cl AS (SELECT video_id, CAST(trunc(timestamp * 25) AS BIGINT) AS frame_idx, row_ord,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, x1)) AS x1, greatest(0.0::DOUBLE, least(1.0::DOUBLE, y1)) AS y1,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, x2)) AS x2, greatest(0.0::DOUBLE, least(1.0::DOUBLE, y2)) AS y2 FROM annotations),
b AS (SELECT video_id, frame_idx, min(row_ord) AS box_id, x1, y1, x2, y2 FROM cl WHERE x1 < x2 AND y1 < y2 GROUP BY ALL),
fr AS (SELECT video_id, frame_idx, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS fp
  FROM (SELECT DISTINCT video_id, frame_idx FROM b)),
bf AS (SELECT b.*, fp FROM b JOIN fr USING (video_id, frame_idx))"""


def track_boxes(spark, sf):
    rows = fb.drop_degenerate(fb.clamp_boxes(fb.with_frame_index(dt.annotations(spark, sf))))
    return rows.groupBy("video_id", "frame_idx", "x1", "y1", "x2", "y2").agg(F.min("row_ord").alias("box_id"))


@query("iou_tracks", f"""{BOXES_SQL},
pr AS (SELECT p.box_id AS a, q.box_id AS n,
  greatest(least(p.x2,q.x2)-greatest(p.x1,q.x1), 0.0::DOUBLE) * greatest(least(p.y2,q.y2)-greatest(p.y1,q.y1), 0.0::DOUBLE) AS s,
  (p.x2-p.x1)*(p.y2-p.y1) + (q.x2-q.x1)*(q.y2-q.y1) AS t
  FROM bf p JOIN bf q ON p.video_id = q.video_id AND q.fp = p.fp + 1),
ok AS (SELECT a, n, s / (t - s) AS iou FROM pr WHERE s / (t - s) >= {MIN_IOU} AND s > 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY iou DESC, n) AS ra, row_number() OVER (PARTITION BY n ORDER BY iou DESC, a) AS rn FROM ok),
lk AS (SELECT a, n FROM rk WHERE ra = 1 AND rn = 1),
w AS (SELECT box_id, coalesce(a, box_id) AS parent, a IS NULL AS head FROM b LEFT JOIN lk ON lk.n = box_id),
c0 AS (SELECT w.box_id, w.parent, w.head FROM w)
SELECT b.video_id, b.frame_idx, b.box_id, ch.track_id, ch.age FROM b JOIN (
  WITH RECURSIVE chain(box_id, track_id, age) AS (
    SELECT box_id, box_id, 0::BIGINT FROM c0 WHERE head
    UNION ALL SELECT c0.box_id, chain.track_id, chain.age + 1 FROM chain JOIN c0 ON c0.parent = chain.box_id AND NOT c0.head)
  SELECT * FROM chain) ch USING (box_id)
""")
def iou_tracks(spark, sf):
    return quality.iou_tracks(track_boxes(spark, sf), MIN_IOU)


MAX_GAP = 3


@query("tracked_boxes", f"""{BOXES_SQL},
pr AS (SELECT p.box_id AS a, q.box_id AS n, q.fp - p.fp AS gap,
  greatest(least(p.x2,q.x2)-greatest(p.x1,q.x1), 0.0::DOUBLE) * greatest(least(p.y2,q.y2)-greatest(p.y1,q.y1), 0.0::DOUBLE) AS s,
  (p.x2-p.x1)*(p.y2-p.y1) + (q.x2-q.x1)*(q.y2-q.y1) AS t
  FROM bf p JOIN bf q ON p.video_id = q.video_id AND q.fp > p.fp AND q.fp <= p.fp + {MAX_GAP}),
ok AS (SELECT a, n, gap, s / (t - s) AS iou FROM pr WHERE s / (t - s) >= {MIN_IOU} AND s > 0),
m(a, n, gap, iou, pick) AS (
  SELECT a, n, gap, iou, false FROM ok
  UNION ALL
  SELECT a, n, gap, iou, ra = 1 AND rn = 1 FROM (
    SELECT *, row_number() OVER (PARTITION BY a ORDER BY gap, iou DESC, a, n) AS ra,
      row_number() OVER (PARTITION BY n ORDER BY gap, iou DESC, a, n) AS rn
    FROM (SELECT *, bool_or(pick) OVER (PARTITION BY a) AS pa, bool_or(pick) OVER (PARTITION BY n) AS pn FROM m)
    WHERE NOT pa AND NOT pn)),
lk AS (SELECT a, n, gap FROM m WHERE pick),
chain(box_id, track_id, age, gap) AS (
  SELECT box_id, box_id, 0::BIGINT, NULL::BIGINT FROM b WHERE box_id NOT IN (SELECT n FROM lk)
  UNION ALL SELECT lk.n, chain.track_id, chain.age + 1, lk.gap FROM chain JOIN lk ON lk.a = chain.box_id)
SELECT b.video_id, b.frame_idx, b.box_id, track_id, age, CAST(chain.gap AS INTEGER) AS gap FROM b JOIN chain USING (box_id)
""", views=f"RECURSIVE {dt.ANNOTATIONS_SQL}")
def tracked_boxes(spark, sf):
    return quality.tracked_boxes(track_boxes(spark, sf), MIN_IOU, MAX_GAP)


ARRAYS_SQL = FILLED_SQL + """,
arr AS (SELECT video_id, target_id, start, list(coalesce(source_vec, -1) ORDER BY i) AS v FROM filled GROUP BY ALL)"""


def window_arrays(spark, sf):
    rows = normal_rows(spark, sf).select(*TRACK, "timestamp", "row_ord", "valid", "vec_id")
    filled = tracks.gap_filled_windows(rows, "vec_id", F.lit(-1).cast("long"), SEQ_LEN, STRIDE)
    return tracks.assemble_windows(filled, "vec_id")


@query("corruptions", ARRAYS_SQL + """,
u AS (SELECT *, video_id || ':' || target_id || ':' || start AS name FROM arr),
rk AS (SELECT name, v, row_number() OVER (ORDER BY sha256('42:' || name), name) - 1 AS r, count(*) OVER () AS n FROM u),
dn AS (SELECT a.name, b.v AS donor FROM rk a JOIN rk b ON b.r = (a.r + 1) % a.n)
SELECT u.video_id, u.target_id, u.start, array_to_string(list_reverse(v), ',') AS reversed,
  (SELECT string_agg(v[k+1], ',' ORDER BY k) FROM range(16) t(k) WHERE k % 2 = 0) AS skipped,
  (SELECT string_agg(v[k//2+1], ',' ORDER BY k) FROM range(16) t(k)) AS repeated,
  (SELECT string_agg(CASE WHEN k < 8 THEN v[k+1] ELSE donor[k+1] END, ',' ORDER BY k) FROM range(16) t(k)) AS inserted,
  (SELECT string_agg(v[least(k*2, 15)+1], ',' ORDER BY k) FROM range(16) t(k)) AS faster,
  (SELECT string_agg(v[k//2+1], ',' ORDER BY k) FROM range(16) t(k)) AS slower
FROM u JOIN dn USING (name)
""")
def corruptions(spark, sf):
    named = materialize(window_arrays(spark, sf).withColumn("name", F.concat_ws(":", *WINDOW)))
    ranked = named.join(hash_rank(named, "name", 42), "name")
    donors = ranked.select("rank", F.col("vec_id").alias("donor"))
    both = ranked.withColumn("rank", (F.col("rank") + 1) % F.col("n_units")).join(donors, "rank")

    def text(column):
        return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")

    return both.select(
        *WINDOW,
        text(fc.reversed_window("vec_id")).alias("reversed"),
        text(fc.skipped("vec_id", 2)).alias("skipped"),
        text(fc.repeated("vec_id", 2)).alias("repeated"),
        text(fc.inserted("vec_id", "donor", 8)).alias("inserted"),
        text(fc.speed_changed("vec_id", 2.0)).alias("faster"),
        text(fc.speed_changed("vec_id", 0.5)).alias("slower"),
    )


@query("shuffled_windows", FILLED_SQL + """
SELECT video_id, target_id, start, string_agg(coalesce(source_vec, -1), ',' ORDER BY
  sha256('42:' || video_id || ':' || target_id || ':' || start || ':' || i)) AS items FROM filled GROUP BY ALL
""")
def shuffled_windows(spark, sf):
    mixed = fc.shuffled("vec_id", 42, *WINDOW)
    return window_arrays(spark, sf).select(
        *WINDOW, F.array_join(F.transform(mixed, lambda x: x.cast("string")), ",").alias("items"))


# --- ledgers ---------------------------------------------------------------

CONFIG_SQL = """,
config AS (SELECT video_id AS run_id, 'action_' || action_id AS key, CAST(count(*) AS VARCHAR) AS value
  FROM annotations GROUP BY video_id, action_id)"""


def config_rows(rows):
    """A configuration per video: how many rows each action has."""
    return rows.groupBy(F.col("video_id").alias("run_id"), "action_id").agg(
        F.count(F.lit(1)).cast("string").alias("value")
    ).select("run_id", F.concat(F.lit("action_"), F.col("action_id").cast("string")).alias("key"), "value")


@query("config_hash", CONFIG_SQL + ", " + fingerprint_sql(
    fingerprint.entry_sql("key", "value"), "config", "run_id, ", "config_hash", "n_keys"))
def config_hash(spark, sf):
    return ledger.config_hash(config_rows(dt.annotations(spark, sf)))


@query("config_diff", """,
o AS (SELECT video_id AS run_id, 'action_' || action_id AS key, CAST(count(*) AS VARCHAR) AS value FROM annotations WHERE valid GROUP BY video_id, action_id),
n AS (SELECT video_id AS run_id, 'action_' || action_id AS key, CAST(count(*) AS VARCHAR) AS value FROM annotations WHERE has_frame GROUP BY video_id, action_id)
SELECT run_id, key, o.value AS old_value, n.value AS new_value,
  CASE WHEN o.value IS NULL THEN 'added' WHEN n.value IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM o FULL JOIN n USING (run_id, key) WHERE o.value IS DISTINCT FROM n.value
""")
def config_diff(spark, sf):
    rows = dt.annotations(spark, sf)
    return ledger.config_diff(
        config_rows(rows.where("valid")), config_rows(rows.where("has_frame")), ["run_id"])


STEPS_SQL = """,
steps AS (SELECT video_id AS run_id, action_id + 1 AS step, timestamp AS completed_at, row_ord AS entry_ord,
  sha256('config-' || target_id) AS config_hash, sha256('weights-' || (row_ord % 2)) AS weights_sha256 FROM annotations),
cur AS (SELECT run_id, step, max(entry_ord) AS entry_ord FROM steps GROUP BY ALL),
latest AS (SELECT s.* FROM steps s JOIN cur USING (run_id, step, entry_ord))"""


def step_rows(spark, sf):
    return dt.annotations(spark, sf).select(
        F.col("video_id").alias("run_id"), (F.col("action_id") + 1).alias("step"),
        F.col("timestamp").alias("completed_at"), F.col("row_ord").alias("entry_ord"),
        F.sha2(F.concat(F.lit("config-"), F.col("target_id").cast("string")), 256).alias("config_hash"),
        F.sha2(F.concat(F.lit("weights-"), (F.col("row_ord") % 2).cast("string")), 256).alias("weights_sha256"),
    )


@query("current_steps", STEPS_SQL + """
SELECT run_id, step, completed_at, entry_ord, config_hash, weights_sha256 FROM latest
""")
def current_steps(spark, sf):
    return ledger.current_steps(step_rows(spark, sf))


@query("step_verdicts", STEPS_SQL + """,
outs AS (SELECT r.run_id, CAST(step AS INT) AS step, step <> 7 AND len(r.run_id) + step <> 8 AS output_exists, sha256('weights-0') AS weights_sha256
  FROM (SELECT DISTINCT run_id FROM steps) r, (SELECT unnest(generate_series(1, 7)) AS step)),
cfg AS (SELECT run_id, CASE WHEN run_id LIKE '%7' THEN NULL ELSE sha256('config-1') END AS config_hash FROM (SELECT DISTINCT run_id FROM steps))
SELECT o.run_id, o.step, CASE WHEN NOT output_exists THEN 'missing' WHEN c.config_hash IS NULL THEN 'reuse'
  WHEN l.run_id IS NULL THEN 'unverified' WHEN l.weights_sha256 <> o.weights_sha256 THEN 'stale'
  WHEN l.config_hash = c.config_hash THEN 'reuse' ELSE 'stale' END AS verdict
FROM outs o LEFT JOIN latest l USING (run_id, step) LEFT JOIN cfg c USING (run_id)
""")
def step_verdicts(spark, sf):
    steps = step_rows(spark, sf)
    runs = steps.select("run_id").distinct()
    outputs = runs.select("run_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("step")).select(
        "run_id", "step",
        ((F.col("step") != 7) & (F.length("run_id") + F.col("step") != 8)).alias("output_exists"),
        F.sha2(F.lit("weights-0"), 256).alias("weights_sha256"))
    configs = runs.select(
        "run_id",
        F.when(~F.col("run_id").endswith("7"), F.sha2(F.lit("config-1"), 256)).alias("config_hash"))
    return ledger.step_verdicts(outputs, steps, configs)


@query("previous_runs", STEPS_SQL + """,
l AS (SELECT run_id, entry_ord, completed_at AS started_at, config_hash, lag(config_hash) OVER w AS previous_hash,
  lag(completed_at) OVER w AS previous_at FROM steps WINDOW w AS (PARTITION BY run_id ORDER BY completed_at, entry_ord))
SELECT * FROM l WHERE previous_hash <> config_hash
""")
def previous_runs(spark, sf):
    runs = step_rows(spark, sf).select(
        "run_id", "entry_ord", F.col("completed_at").alias("started_at"), "config_hash")
    return ledger.previous_runs(runs)


LAYOUT = ("event_id bigint,ts_micros bigint,user_id bigint,event_type string,"
          "value decimal(18,4),props string")


# Timestamps and doubles have no common text in both engines, so they are fixed before.
@query("table_fingerprint", f"""
e AS (SELECT event_id, epoch_us(ts) AS ts_micros, user_id, event_type, CAST(value AS DECIMAL(18,4)) AS value, props FROM events),
d AS (SELECT sha256({fingerprint.entry_sql("event_id", "ts_micros", "user_id", "event_type", "value", "props")}) AS d FROM e),
n AS (SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || substr(d, 1, 15) AS BIGINT)) AS VARCHAR) AS sum_hash,
  bit_xor(CAST('0x' || substr(d, 16, 15) AS BIGINT)) AS xor_hash FROM d)
SELECT '{LAYOUT}' AS layout, n_rows, sum_hash, xor_hash,
  sha256('{LAYOUT}|' || n_rows || '|' || sum_hash || '|' || xor_hash) AS sha256 FROM n
""".replace("e AS (SELECT", ", e AS (SELECT", 1))
def table_fingerprint(spark, sf):
    return fingerprint.table_fingerprint(dt.table(spark, sf, "events").select(
        "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_micros"), "user_id", "event_type",
        F.col("value").cast("decimal(18,4)").alias("value"), "props"))


@query("artifact_ledger")
def artifact_ledger(spark, sf):
    """All table files as artifacts, plus the ones a nation names and nobody made."""
    real = ("region nation customer supplier part orders lineitem events documents embeddings "
            "pages benchmark labels conversations").split()
    folder = sf.rstrip("/")
    named = dt.table(spark, sf, "nation").select(F.lower("n_name").alias("name"))
    names = named.unionByName(spark.createDataFrame([(n,) for n in real], "name string"))
    wanted = names.select("name", F.concat(F.lit(folder + "/"), "name", F.lit(".parquet")).alias("path"))
    return ledger.artifact_ledger(spark, wanted, folder)
