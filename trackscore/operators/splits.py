"""Deterministic grouped splits, sampling and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fingerprint import entry_text, hash_tree
from .ordering import hash_rank


def grouped_split(
    df: DataFrame, unit: str, fractions: dict[str, int] | None = None, seed: int = 42
) -> DataFrame:
    """Assign every unit to one fold: (unit, fold).

    ``fractions`` maps fold names to whole percents; each cut is the rounded-up
    share and the remaining units are ``train``. Order is a seeded hash of the
    unit, so the split depends on neither row order nor process.
    """
    fractions = {"val": 20} if fractions is None else fractions
    fold = F.lit("train")
    share = sum(fractions.values())
    for name in reversed(list(fractions)):
        cut = F.call_function("div", F.col("n_units") * share + 99, F.lit(100))
        fold = F.when(F.col("rank") < cut, F.lit(name)).otherwise(fold)
        share -= fractions[name]
    return hash_rank(df, unit, seed).select(unit, fold.alias("fold"))


def row_split(df: DataFrame, fraction: int = 20, seed: int = 42) -> DataFrame:
    """Row-level split. It leaks between neighbouring frames; kept for comparison."""
    return grouped_split(df, "row_ord", {"val": fraction}, seed)


def sample_units(df: DataFrame, unit: str, percent: int = 20, seed: int = 42) -> DataFrame:
    """A seeded sample without replacement of floor(percent * n) units."""
    ranked = hash_rank(df, unit, seed)
    return ranked.where(F.col("rank") < F.call_function("div", F.col("n_units") * percent, F.lit(100))).select(unit)


def assign_split(df: DataFrame, split: DataFrame, unit: str = "video_id", default: str = "train") -> DataFrame:
    """Attach the fold; units the split does not name get the default."""
    return df.join(split, unit, "left").withColumn("fold", F.coalesce("fold", F.lit(default)))


def split_windows(windows: DataFrame, split: DataFrame, unit: str = "video_id") -> DataFrame:
    """Attach the fold; windows of unnamed units are dropped."""
    return windows.join(split, unit)


def split_sizes(split: DataFrame) -> DataFrame:
    """Units per fold and in total."""
    return split.rollup("fold").agg(F.count(F.lit(1)).alias("n_items")).select(
        F.coalesce("fold", F.lit("total")).alias("fold"), "n_items"
    )


def split_overlap(split: DataFrame, unit: str) -> DataFrame:
    """Number of units that appear in more than one fold; must be zero."""
    return (
        split.groupBy(unit).agg(F.min("fold").alias("low"), F.max("fold").alias("high"))
        .agg(F.coalesce(F.sum((F.col("low") != F.col("high")).cast("long")), F.lit(0)).alias("n_shared"))
    )


def split_fingerprint(
    split: DataFrame, unit: str, ordered_by: str | None = None
) -> DataFrame:
    """One digest of the whole assignment.

    Without ``ordered_by`` row order is ignored; with it, the position is part
    of every entry.
    """
    parts = ["fold", *([ordered_by] if ordered_by else []), unit]
    return hash_tree(split, entry_text(*parts))
