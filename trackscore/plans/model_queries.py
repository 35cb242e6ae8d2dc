"""Queries: reconstruction models and streams."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..functions import keys as fk
from ..functions.vectors import zeros
from ..models import training
from ..operators import events as oe
from ..operators import scaling, splits, store, tracks
from ..schema import TRACK, WINDOW
from ..session import materialize, scratch_path
from ..sources import driver_tables as dt
from ..streaming.events import EVENT_SCHEMA, STORE_PROVIDER, stream_events, tick
from ..streaming.features import start_feature_stream
from .event_queries import EVENTS_SQL, HI, LO, MIN_DURATION, SCORED_SQL
from .registry import query
from .track_queries import DIM, KEY_SQL, key_vector, named_windows


@query("vae_loss_terms", f"""
WITH e AS (SELECT vec_id, unnest(generate_series(1, {DIM})) AS d, unnest(embedding)::DOUBLE AS x,
  unnest(list_reverse(embedding))::DOUBLE AS r FROM embeddings),
rec AS (SELECT vec_id, sum((x - r) * (x - r)) AS recon FROM e GROUP BY vec_id),
lat AS (SELECT m.vec_id, -0.5::DOUBLE * sum(1 + v.x - m.x * m.x - exp(v.x)) AS kl
  FROM e m JOIN e v ON m.vec_id = v.vec_id AND v.d = m.d + 32 GROUP BY m.vec_id)
SELECT vec_id, round(recon, 6) AS recon, round(kl, 6) AS kl, round(recon + kl, 6) AS loss FROM rec JOIN lat USING (vec_id)
""", views=None)
def vae_loss_terms(spark, sf):
    rows = dt.features(spark, sf).select(
        "vec_id", "feature", F.reverse("feature").alias("reconstruction"),
        F.slice("feature", 1, 32).alias("mu"), F.slice("feature", 33, 32).alias("logvar"))
    return training.vae_loss_terms(rows).select(
        "vec_id", *[F.round(c, 6).alias(c) for c in ("recon", "kl", "loss")])


LOSSES_SQL = """,
b AS (SELECT CASE WHEN target_id = 0 THEN 'sequence_vae' ELSE 'flat_vae' END AS model, CAST(action_id + 1 AS INT) AS epoch,
  CASE WHEN row_ord % 5 = 0 THEN 'val' ELSE 'train' END AS split, row_ord // 64 AS batch,
  e.value AS recon, e.value / 4 AS kl, e.value * 1.25::DOUBLE AS loss FROM annotations a JOIN events e ON e.event_id = a.row_ord),
s AS (SELECT model, epoch, split, sum(loss) AS loss, sum(recon) AS recon, sum(kl) AS kl,
  count(DISTINCT batch) AS nb, count(*) AS nr FROM b GROUP BY ALL)"""


def batch_losses(spark, sf):
    """Loss records per (model, epoch, split, batch), from event values."""
    rows = dt.annotations(spark, sf, "value").select("target_id", "action_id", "row_ord", "value")
    return rows.groupBy(
        F.when(F.col("target_id") == 0, "sequence_vae").otherwise("flat_vae").alias("model"),
        (F.col("action_id") + 1).cast("int").alias("epoch"),
        F.when(F.col("row_ord") % 5 == 0, "val").otherwise("train").alias("split"),
        F.floor(F.col("row_ord") / 64).alias("batch"),
    ).agg(
        F.sum(F.col("value") * 1.25).alias("loss"), F.sum("value").alias("recon"),
        F.sum(F.col("value") / 4).alias("kl"), F.lit(1).cast("long").alias("n_batches"),
        F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) * DIM).alias("n_elements"))


@query("loss_reduction", LOSSES_SQL + """,
t AS (SELECT model, epoch, sum(nr) AS n FROM s GROUP BY ALL)
SELECT 'batches' AS divisor, model, epoch, split, round(loss / nb, 6) AS loss, round(recon / nb, 6) AS recon, round(kl / nb, 6) AS kl FROM s
UNION ALL SELECT 'dataset', model, epoch, split, round(loss / n, 6), round(recon / n, 6), round(kl / n, 6) FROM s JOIN t USING (model, epoch)
UNION ALL SELECT 'elements', model, epoch, split, round(loss / (nr * 64), 6), round(recon / (nr * 64), 6), round(kl / (nr * 64), 6) FROM s
""")
def loss_reduction(spark, sf):
    losses = batch_losses(spark, sf)
    result = None
    for divisor in ("batches", "dataset", "elements"):
        part = training.reduce_losses(losses, divisor).select(
            F.lit(divisor).alias("divisor"), "model", "epoch", "split",
            *[F.round(c, 6).alias(c) for c in ("loss", "recon", "kl")])
        result = part if result is None else result.unionByName(part)
    return result


@query("loss_history", LOSSES_SQL + """
SELECT model, epoch, """ + ", ".join(
    f"round(max({t} / nb) FILTER (split = '{s}'), 6) AS {s}_{t}" for s in ("train", "val") for t in ("loss", "recon", "kl")) + """
FROM s GROUP BY ALL
""")
def loss_history(spark, sf):
    history = training.history_frame(training.reduce_losses(batch_losses(spark, sf)))
    return history.select("model", "epoch", *[
        F.round(c, 6).alias(c) for c in history.columns if c not in ("model", "epoch")])


def flat_rows(spark, sf):
    rows = dt.features(spark, sf)
    rows = splits.assign_split(rows, splits.grouped_split(rows, "vec_id"), "vec_id")
    return scaling.minmax_fit_apply(rows, "train")


SMALL = {"hidden_dim": 32, "latent_dim": 8}


@query("vae_history")
def vae_history(spark, sf):
    _, _, losses = training.fit_vae(flat_rows(spark, sf), "vec_id", DIM, epochs=3, **SMALL)
    return training.history_frame(training.reduce_losses(losses, "batches"))


@query("vae_scores")
def vae_scores(spark, sf):
    rows = flat_rows(spark, sf)
    kernel, weights, _ = training.fit_vae(rows, "vec_id", DIM, epochs=2, **SMALL)
    return training.score_model(rows, kernel, weights).select(
        "vec_id", F.round("score", 6).alias("score"))


def sequence_rows(spark, sf):
    """Scaled windows. Vectors join once, by narrow rows, and are kept unscaled: training and scoring read them again."""
    named, vectors = materialize(named_windows(spark, sf)), dt.features(spark, sf).select("vec_id", "feature")
    scaler = scaling.fit_zscore_by_key(scaling.select_fold(named, "train"), vectors, "vec_id")
    rows = tracks.attach_features(named.select(*WINDOW, "fold", "i", "vec_id"), vectors, "vec_id").withColumn(
        "feature", F.coalesce("feature", zeros(DIM)))
    whole = materialize(tracks.assemble_windows(rows, "feature", keep=["fold"]))
    return scaling.zscore_apply(whole, scaler).withColumn("window", F.concat_ws(":", *WINDOW))


@query("sequence_vae_scores")
def sequence_vae_scores(spark, sf):
    rows = sequence_rows(spark, sf)
    kernel, weights, _ = training.fit_sequence_vae(rows, "window", DIM, epochs=1, **SMALL)
    return training.score_model(rows, kernel, weights).select(
        *WINDOW, F.round("score", 6).alias("score"))


def event_stream(spark, sf):
    """The events table as a stream."""
    schema = dt.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("stream_features", f"""
SELECT key, f % 11 <> 0 AS valid FROM (
  SELECT DISTINCT {KEY_SQL} AS key, CAST(trunc(timestamp * 25) AS BIGINT) AS f FROM annotations)
""")
def stream_features(spark, sf):
    path = scratch_path(spark, "store")
    signature = fk.store_signature("1" * 64)
    keys = fk.with_feature_key(dt.annotation_view(event_stream(spark, sf), dt.vector_count(spark, sf))).select("key")
    start_feature_stream(
        keys, path, signature, key_vector, scratch_path(spark, "stream")).awaitTermination()
    return store.read_store(spark, path, signature).select("key", "valid")


ROUNDS = 4


@query("stream_feature_dedup", f"""
SELECT key, f % 11 <> 0 AS valid FROM (
  SELECT DISTINCT {KEY_SQL} AS key, CAST(trunc(timestamp * 25) AS BIGINT) AS f FROM annotations)
""")
def stream_feature_dedup(spark, sf):
    """The stored keys after a stream of several triggers, with repeats and a restart.

    A quarter of the events arrives per trigger, each with a second copy of the quarter before;
    the stream stops half-way and goes on from its checkpoint.
    """
    rows = fk.with_feature_key(dt.annotations(spark, sf, "ts")).select(
        "key", F.col("ts").cast("timestamp").alias("event_time"), F.col("row_ord").alias("at"))
    n = rows.agg(F.max("at")).first()[0] or 0
    source, path, state = (scratch_path(spark, name) for name in ("keys", "store", "stream"))
    signature = fk.store_signature("1" * 64)
    quarter = F.floor(F.col("at") * ROUNDS / (n + 1))
    for turn in range(ROUNDS):
        # One file is one trigger.
        rows.where(quarter.isin(turn, turn - 1)).select("key", "event_time").coalesce(1).write.mode("append").parquet(source)
        if turn in (1, ROUNDS - 1):
            keys = spark.readStream.schema("key string, event_time timestamp").option("maxFilesPerTrigger", 1).parquet(source)
            start_feature_stream(keys, path, signature, key_vector, state, "event_time", "12 hours").awaitTermination()
    return store.read_store(spark, path, signature).select("key", "valid")


DELAY = timedelta(minutes=10)
DAY = 86_400.0
#: No track is silent for so long; and a time that tracks often are.
NEVER_IDLE, IDLE = 366 * DAY, 1.5 * DAY


def streamed_events(spark, sf, idle, slot=DAY):
    """Events of the event stream. After its end a tick moves the watermark on, so that every event closes."""
    scored = dt.annotation_view(event_stream(spark, sf), dt.vector_count(spark, sf), "ts", "value").select(
        *TRACK, "timestamp", "row_ord", F.col("value").alias("score"),
        F.col("ts").cast("timestamp").alias("event_time"))
    latest = dt.table(spark, sf, "events").agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    path, ticks, state = (scratch_path(spark, name) for name in ("events", "ticks", "stream"))
    spark.createDataFrame([], scored.schema).write.parquet(ticks)
    both = scored.unionByName(spark.readStream.schema(scored.schema).parquet(ticks))
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE_PROVIDER)

    def run():
        stream_events(both, HI, LO, MIN_DURATION, f"{DELAY.seconds} seconds", idle, slot).writeStream.format("parquet").option(
            "path", path).option("checkpointLocation", state).outputMode("append").trigger(
            availableNow=True).start().awaitTermination()

    try:
        run()
        if latest is not None:
            end = [(None, None, None, None, None, tick(latest, DELAY, idle, slot))]
            spark.createDataFrame(end, scored.schema).write.mode("append").parquet(ticks)
            run()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    return spark.read.schema(EVENT_SCHEMA).parquet(path).withColumn("duration", F.round("duration", 6))


@query("stream_events", EVENTS_SQL + """
SELECT video_id, target_id, t_start, t_end, peak, round(t_end - t_start, 6) AS duration FROM found
""")
def stream_event_query(spark, sf):
    """The same events as those of all rows at once."""
    return streamed_events(spark, sf, NEVER_IDLE)


IDLE_EVENTS_SQL = SCORED_SQL + f""",
ms AS (SELECT s.*, epoch_ms(e.ts) AS at_ms FROM scored s JOIN events e ON e.event_id = s.row_ord),
gap AS (SELECT *, coalesce(at_ms - lag(at_ms) OVER w > {IDLE * 1000}, false) AS silent FROM ms
  WINDOW w AS (PARTITION BY video_id, target_id ORDER BY timestamp, row_ord)),
e1 AS (SELECT *, sum(CASE WHEN score < {LO} OR silent THEN 1 ELSE 0 END) OVER w AS stretch,
  sum(CASE WHEN score < {HI} OR silent THEN 1 ELSE 0 END) OVER w AS run FROM gap
  WINDOW w AS (PARTITION BY video_id, target_id ORDER BY timestamp, row_ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
e2 AS (SELECT video_id, target_id, stretch, run, min(timestamp) FILTER (score >= {HI}) AS b, max(timestamp) FILTER (score >= {HI}) AS e,
  max(score) FILTER (score >= {HI}) AS top, max(timestamp) AS last FROM e1 WHERE score >= {LO} GROUP BY ALL)
SELECT video_id, target_id, min(b) FILTER (e - b >= {MIN_DURATION}) AS t_start, max(last) AS t_end,
  max(top) FILTER (e - b >= {MIN_DURATION}) AS peak,
  round(max(last) - min(b) FILTER (e - b >= {MIN_DURATION}), 6) AS duration FROM e2 GROUP BY video_id, target_id, stretch
  HAVING count(*) FILTER (e - b >= {MIN_DURATION}) > 0
"""


@query("idle_events", IDLE_EVENTS_SQL)
def idle_events(spark, sf):
    """Events of all rows; a silent track ends its event."""
    rows = dt.annotations(spark, sf, "value", "ts").select(
        *TRACK, "timestamp", "row_ord", F.col("value").alias("score"),
        (F.unix_millis(F.col("ts").cast("timestamp")) / 1000).alias("seconds"))
    return oe.extract_events(rows, HI, LO, MIN_DURATION, idle=IDLE, clock="seconds").withColumn("duration", F.round("duration", 6))


@query("stream_idle_events", IDLE_EVENTS_SQL)
def stream_idle_events(spark, sf):
    """The same events on the stream, where timers end those of silent tracks."""
    return streamed_events(spark, sf, IDLE)
