"""From scores to events, and events against truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TRACK
from ..session import materialize
from .ordering import CHUNK_ROWS, HOT_GROUP_ROWS, ordered
from .tracks import tracks


def extract_events(
    scored: DataFrame, hi: float, lo: float, min_duration: float, keys: list[str] | None = None,
    idle: float | None = None, clock: str = "timestamp", **plan
) -> DataFrame:
    """Events with hysteresis.

    An event opens at the first run of scores >= hi that lasts at least
    ``min_duration`` and closes before the first score < lo. Since hi >= lo,
    such runs lie inside the stretches without a score < lo: both are runs
    between breaks, numbered by two running counts and folded by aggregation.
    With ``idle`` an event also closes before a row whose ``clock`` is more than
    ``idle`` after that of the row before it. Rows without a score take no part.
    """
    if hi < lo:
        raise ValueError("hi must not be below lo")
    keys = keys or TRACK
    track = ordered(
        scored.where(F.col("score").isNotNull()).withColumns({
            "_low": (F.col("score") < lo).cast("long"),
            "_not_high": (F.col("score") < hi).cast("long"),
        }),
        keys, ["timestamp", "row_ord"], **plan)
    high = F.col("_not_high") == 0
    breaks = {"_stretch": ("sum", "_low"), "_run": ("sum", "_not_high")}
    if idle is not None:
        track = track.lag(clock, "_before")
        silent = F.coalesce((F.col(clock) - F.col("_before") > idle).cast("long"), F.lit(0))
        track = track.with_rows(track.rows.withColumns({
            "_break_low": F.greatest("_low", silent), "_break_run": F.greatest("_not_high", silent)}))
        breaks = {"_stretch": ("sum", "_break_low"), "_run": ("sum", "_break_run")}
    track = track.running(**breaks)
    runs = track.rows.where(F.col("_low") == 0).groupBy(*keys, "_stretch", "_run").agg(
        F.min(F.when(high, F.col("timestamp"))).alias("start"),
        F.max(F.when(high, F.col("timestamp"))).alias("stop"),
        F.max(F.when(high, F.col("score"))).alias("top"),
        F.max("timestamp").alias("last"),
    )
    lasting = F.col("stop") - F.col("start") >= min_duration
    return (
        runs.groupBy(*keys, "_stretch").agg(
            F.min(F.when(lasting, F.col("start"))).alias("t_start"),
            F.max("last").alias("t_end"),
            F.max(F.when(lasting, F.col("top"))).alias("peak"),
        )
        .where(F.col("t_start").isNotNull())
        .select(*keys, "t_start", "t_end", "peak", (F.col("t_end") - F.col("t_start")).alias("duration"))
    )


def truth_manifest(df: DataFrame, **plan) -> DataFrame:
    """Runs of one action per track: (video, track, start, end, type, fold).

    In the leave-one-action-out setting the runs of an action are the novelty
    truth of the fold that holds it out, so ``fold`` is the action.
    """
    track = tracks(df, **plan).lag("action_id", "_previous")
    changed = track.with_rows(track.rows.withColumn(
        "_change", (~F.col("_previous").eqNullSafe(F.col("action_id"))).cast("long")))
    return changed.running(_run=("sum", "_change")).rows.groupBy(*TRACK, "_run").agg(
        F.min("timestamp").alias("t_start"), F.max("timestamp").alias("t_end"),
        F.first("action_id").alias("fold"), F.count(F.lit(1)).alias("n_rows"),
    ).select(
        "video_id", F.col("target_id").alias("track_id"), "t_start", "t_end",
        F.concat(F.lit("action_"), F.col("fold").cast("string")).alias("novelty_type"), "fold", "n_rows",
    )


def leave_one_out(df: DataFrame) -> DataFrame:
    """Per held-out action: training rows left, held-out rows and their ratio."""
    counts = df.groupBy("action_id").agg(F.count(F.lit(1)).alias("held_out"))
    total = counts.agg(F.sum("held_out").alias("total")).first().total or 0
    kept = F.lit(total) - F.col("held_out")
    return counts.select(
        F.col("action_id").alias("fold"), "held_out", kept.alias("retained"),
        F.when(kept > 0, F.col("held_out") / kept).alias("novelty_ratio"))


def loo_folds(df: DataFrame) -> DataFrame:
    """Every row once per held-out action, marked train or test.

    The list of actions is a few numbers; each row is repeated over it without a shuffle.
    """
    actions = sorted(r[0] for r in df.select("action_id").where("action_id is not null").distinct().collect())
    return df.withColumn("fold", F.explode(F.array(*[F.lit(int(a)) for a in actions]).cast("array<int>"))).withColumn(
        "part", F.when(F.col("action_id") == F.col("fold"), F.lit("test")).otherwise(F.lit("train")))


def as_of(
    left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str,
    value: str, out: str, direction: str = "previous",
    hot_rows: int = HOT_GROUP_ROWS, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """For each left row the nearest right (time, value) at or before / at or after.

    Both sides are merged into one ordered sequence per key and the nearest
    right row is a running extreme: linear, however many rows share a key. Ties
    resolve by a hash of the row, so positions are the same at every evaluation.
    ``out`` is a struct (at, value), NULL where there is none.
    """
    sign = 1.0 if direction == "previous" else -1.0
    at = F.struct(
        F.col(right_time).cast("double").alias("at"), F.col(value).alias("value"))
    lefts = left.select(
        *keys, (F.col(left_time) * sign).alias("_time"), F.lit(1).alias("_side"), F.xxhash64(*left.columns).alias("_tie"),
        F.struct(*left.columns).alias("_left"), F.lit(None).cast(_type_of(right, at)).alias("_near"))
    rights = right.select(
        *keys, (F.col(right_time) * sign).alias("_time"), F.lit(0).alias("_side"), F.xxhash64(right_time, value).alias("_tie"),
        F.lit(None).cast(_type_of(left, F.struct(*left.columns))).alias("_left"), at.alias("_near"))
    chain = ordered(lefts.unionByName(rights), keys, ["_time", "_side", "_tie"], hot_rows=hot_rows, chunk_rows=chunk_rows)
    chain = chain.running(**{out: ("max" if direction == "previous" else "min", "_near")})
    return chain.rows.where(F.col("_side") == 1).select("_left.*", out)


def _type_of(df: DataFrame, column) -> str:
    return df.select(column.alias("c")).schema["c"].dataType.simpleString()


def detection_delay(truth: DataFrame, events: DataFrame, keys: list[str], **plan) -> DataFrame:
    """Seconds from each truth start to the first event that starts inside it."""
    events, truth = materialize(events), materialize(truth)
    nearest = as_of(truth, events, keys, "t_start", "t_start", "t_end", "_event", "next", **plan)
    inside = F.col("_event.at") <= F.col("t_end")
    return nearest.select(
        *keys, "t_start", "t_end",
        F.when(inside, F.col("_event.at") - F.col("t_start")).alias("delay"))


def matched(left: DataFrame, right: DataFrame, keys: list[str], **plan) -> DataFrame:
    """Mark left intervals that overlap a right one (both disjoint per key).

    Among right intervals that start by the end of the left one, the last to
    start also ends last; the two overlap if it reaches the left start.
    """
    nearest = as_of(left, right, keys, "t_end", "t_start", "t_end", "_other", "previous", **plan)
    return nearest.withColumn(
        "matched", F.coalesce(F.col("_other.value") >= F.col("t_start"), F.lit(False))).drop("_other")


def event_metrics(
    events: DataFrame, truth: DataFrame, observed: DataFrame, keys: list[str], **plan
) -> DataFrame:
    """Event-level detection rate, durations and false events per day.

    ``observed`` gives the seconds watched per camera (``seconds``). Events and
    truth are read several times, so each is computed once and kept.
    """
    events, truth = materialize(events), materialize(truth)
    found = matched(truth, events, keys, **plan).agg(
        F.count(F.lit(1)).alias("n_truth"), F.count_if("matched").alias("n_detected"))
    raised = matched(events, truth, keys, **plan).agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(~F.col("matched")).alias("n_false"),
        F.avg("duration").alias("mean_duration"))
    watched = observed.agg((F.sum("seconds") / 86400).alias("days"))
    one = F.lit(1).alias("_one")
    joined = found.select("*", one).join(raised.select("*", one), "_one").join(
        watched.select("*", one), "_one").drop("_one")
    return joined.withColumns({
        "detection_rate": F.when(F.col("n_truth") > 0, F.col("n_detected") / F.col("n_truth")),
        "false_per_day": F.when(F.col("days") > 0, F.col("n_false") / F.col("days")),
    })
