"""Digests of tables and of groups of entries, independent of row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def entry_text(*columns: str) -> Column:
    """Fields as one text from which they can be read back: each with its length, NULL as "-"."""
    fields = []
    for name in columns:
        text = F.col(name).cast("string")
        fields.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat(*fields)


def entry_sql(*columns: str) -> str:
    """``entry_text`` in SQL."""
    fields = [f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns]
    return " || ".join(fields)


# Hex digits that name a group on each level of the tree, leaves first.
LEVELS = (6, 3)


def hash_tree(df: DataFrame, entry: Column, keys: list[str] | None = None) -> DataFrame:
    """SHA-256 of the multiset of entries of each group, as a tree of digests.

    Copies fold before the shuffle. Entry hashes are uniform: they are grouped by
    their first six hex digits (16.7 million groups) and each group is hashed,
    then group digests by their first three, then the at most 4,096 digests left.
    No task holds a whole group, and a trillion entries stay at some ten
    thousand per leaf group.
    """
    keys = keys or []
    level = df.groupBy(*keys, F.sha2(entry, 256).alias("_name")).agg(
        F.count(F.lit(1)).alias("_n"))
    level = level.withColumn(
        "_digest", F.concat("_name", F.lit("x"), F.col("_n").cast("string")))
    for digits in LEVELS:
        level = _fold(level, [*keys, F.substring("_name", 1, digits).alias("_name")])
        level = level.withColumn("_digest", F.concat("_name", F.lit(":"), "_digest"))
    return _fold(level, keys).select(
        *keys, F.col("_digest").alias("sha256"), F.coalesce("_n", F.lit(0)).alias("n_items"))


def _fold(level: DataFrame, by: list) -> DataFrame:
    return level.groupBy(*by).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list("_digest")), ","), 256).alias("_digest"),
        F.sum("_n").alias("_n"),
    )


def table_fingerprint(df: DataFrame, ordered_by: str | None = None) -> DataFrame:
    """Identity of a table: column names and types, row count and values.

    Row digests are added and XORed, so the work is one scan and one row per
    task is shuffled. Row order counts only if a position column is named.
    """
    columns = [c for c in df.columns if c != ordered_by]
    if ordered_by:
        columns = [*columns, ordered_by]
    layout = ",".join(f"{name} {dict(df.dtypes)[name]}" for name in columns)
    digests = df.select(F.sha2(entry_text(*columns), 256).alias("d"))

    def number(start: int) -> Column:
        return F.conv(F.substring("d", start, 15), 16, 10).cast("long")

    return digests.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(number(1).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum_hash"),
        F.coalesce(F.bit_xor(number(16)), F.lit(0)).alias("xor_hash"),
    ).select(
        F.lit(layout).alias("layout"), "n_rows", "sum_hash", "xor_hash",
        F.sha2(F.concat_ws("|", F.lit(layout), F.col("n_rows").cast("string"), "sum_hash",
                           F.col("xor_hash").cast("string")), 256).alias("sha256"),
    )
