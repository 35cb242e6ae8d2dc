"""Checks over fitted state and identities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scaling import dimension_stats, select_fold


def changed_statistics(
    df: DataFrame, fit: Callable[[DataFrame], DataFrame], column: str = "feature", fold: str = "train"
) -> DataFrame:
    """Rows of fitted state that move when the rows outside ``fold`` are perturbed.

    ``fit`` is the fit under test; it gets all rows with their ``fold`` and returns its
    state as rows. It runs twice: on the rows as they are, and with every vector outside
    the fold replaced by another. Anything but zero is leakage.
    """
    perturbed = df.withColumn(
        column,
        F.when(F.col("fold") == fold, F.col(column)).otherwise(
            F.transform(column, lambda x: (x * 2 + 100).cast("float"))),
    )
    before, after = fit(df), fit(perturbed)
    moved = before.exceptAll(after).unionByName(after.exceptAll(before))
    return moved.agg(F.count(F.lit(1)).alias("n_changed"))


def rounded_statistics(df: DataFrame, fit_on: str, column: str = "feature") -> DataFrame:
    """Per-dimension statistics of a fold, rounded so that sums in another order compare equal."""
    stats = dimension_stats(select_fold(df, fit_on), column)
    return stats.select("dim", "n", *[F.round(c, 9).alias(c) for c in ("low", "high", "mean", "std")])


def identity_counts(df: DataFrame) -> DataFrame:
    """Distinct targets per video."""
    return df.groupBy("video_id").agg(F.countDistinct("target_id").alias("n_targets"))


def identity_conflicts(df: DataFrame) -> DataFrame:
    """(video, target, frame) combinations held by more than one row."""
    return (
        df.groupBy("video_id", "target_id", "frame_idx").agg(F.count(F.lit(1)).alias("n_rows"))
        .where(F.col("n_rows") > 1)
    )
