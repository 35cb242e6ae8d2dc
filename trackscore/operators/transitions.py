"""Discrete state transitions per track."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import Ordered

PAIR = ["prev_state", "state"]


def with_previous(track: Ordered, state: str = "action_id") -> DataFrame:
    """Rows with the state before them; first rows of a track are left out."""
    rows = track.lag(state, "prev_state").rows
    return rows.where(F.col("pos") > 0).withColumn("state", F.col(state))


def fit_transitions(pairs: DataFrame) -> DataFrame:
    """P(state | previous state). Pairs fold before the shuffle, so one state may
    hold most of the rows."""
    counts = pairs.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("prev_state").agg(F.sum("n").alias("total"))
    return counts.join(totals, "prev_state").select(
        *PAIR, "n", (F.col("n") / F.col("total")).alias("probability"))


def score_transitions(pairs: DataFrame, model: DataFrame, floor: float = 1e-6) -> DataFrame:
    """``score`` = -log P; a transition never seen gets the floor probability."""
    return pairs.join(model.select(*PAIR, "probability"), PAIR, "left").withColumn(
        "score", -F.ln(F.coalesce("probability", F.lit(floor)))).drop("probability")


def unseen_transitions(pairs: DataFrame, train: DataFrame) -> DataFrame:
    """Transitions whose two states occur in train but whose pair does not."""
    known = train.select(F.col("state").alias("s")).union(
        train.select(F.col("prev_state").alias("s"))).distinct()
    return (
        pairs.join(train.select(*PAIR).distinct(), PAIR, "left_anti")
        .join(known.withColumnRenamed("s", "state"), "state", "left_semi")
        .join(known.withColumnRenamed("s", "prev_state"), "prev_state", "left_semi")
    )
