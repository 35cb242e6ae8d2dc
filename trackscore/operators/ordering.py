"""Order-dependent operators that survive a group holding much of the data.

A plain Spark window sorts each group in one task. That is the best plan while
every group fits a task, and the wrong one when a single group holds a third of
all rows. ``Ordered`` therefore checks the group sizes first (one partially
aggregated count) and keeps two plans:

* no hot group: one shuffle on the group keys, textbook windows;
* hot groups: their rows are range-partitioned on (keys, order), numbered
  within each range, shifted by the counts of the earlier ranges, and every
  later window works on bounded chunks of positions.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

HOT_GROUP_ROWS = 1_000_000
CHUNK_ROWS = 100_000
MAX_LISTED_GROUPS = 10_000


@dataclass(frozen=True)
class Ordered:
    """Rows of ordered groups: ``pos`` is the 0-based rank, ``group_rows`` the size."""

    rows: DataFrame
    keys: tuple[str, ...]
    pos: str
    size: str
    hot: bool
    chunk_rows: int

    def with_rows(self, rows: DataFrame) -> "Ordered":
        """The same ordering over derived rows (which must keep keys and pos)."""
        return replace(self, rows=rows)

    def _chunk(self) -> Column:
        return F.floor(F.col(self.pos) / F.lit(self.chunk_rows)).cast("long")

    def over_neighbours(self, before: int, after: int, exprs: dict) -> "Ordered":
        """Add window expressions that look at most ``before``/``after`` rows away.

        Each expression is a function of the ordered window. In the hot plan
        every chunk also receives copies of the rows just outside it, so the
        result is exact and no task sees more than a chunk and its margins.
        """
        if not self.hot:
            window = Window.partitionBy(*self.keys).orderBy(self.pos)
            return self.with_rows(
                self.rows.select("*", *[make(window).alias(name) for name, make in exprs.items()])
            )
        # A row is a neighbour of those from pos - after to pos + before, in however many chunks they lie.
        def chunk_of(position: Column) -> Column:
            return F.floor(position / F.lit(self.chunk_rows)).cast("long")

        homes = F.sequence(
            chunk_of(F.greatest(F.lit(0).cast("long"), F.col(self.pos) - after)), chunk_of(F.col(self.pos) + before))
        placed = self.rows.select("*", F.explode(homes).alias("_chunk"))
        window = Window.partitionBy(*self.keys, "_chunk").orderBy(self.pos)
        computed = placed.select("*", *[make(window).alias(name) for name, make in exprs.items()])
        return self.with_rows(computed.where(F.col("_chunk") == self._chunk()).drop("_chunk"))

    def lag(self, column: str, out: str, k: int = 1) -> "Ordered":
        return self.over_neighbours(k, 0, {out: lambda w: F.lag(column, k).over(w)})

    def lead(self, column: str, out: str, k: int = 1) -> "Ordered":
        return self.over_neighbours(0, k, {out: lambda w: F.lead(column, k).over(w)})

    def running(self, **specs: tuple[str, str]) -> "Ordered":
        """Running values up to and including each row: ``out=(kind, column)``.

        ``kind`` is ``sum``, ``max`` or ``min``; NULLs are skipped. In the hot
        plan all of them share one pass over the chunks and one small table of
        chunk totals, whose prefix is added to the values inside each chunk.
        """
        combine = {out: COMBINE[kind] for out, (kind, _) in specs.items()}
        if not self.hot:
            window = (
                Window.partitionBy(*self.keys).orderBy(self.pos)
                .rowsBetween(Window.unboundedPreceding, Window.currentRow)
            )
            return self.with_rows(self.rows.select(
                "*", *[combine[out](column).over(window).alias(out) for out, (_, column) in specs.items()]))
        chunked = self.rows.withColumn("_chunk", self._chunk())
        inside = (
            Window.partitionBy(*self.keys, "_chunk").orderBy(self.pos)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        earlier = Window.partitionBy(*self.keys).orderBy("_chunk").rowsBetween(
            Window.unboundedPreceding, -1
        )
        totals = chunked.groupBy(*self.keys, "_chunk").agg(
            *[combine[out](column).alias(f"_t_{out}") for out, (_, column) in specs.items()])
        carry = totals.select(
            *self.keys, "_chunk", *[combine[out](f"_t_{out}").over(earlier).alias(f"_c_{out}") for out in specs])
        local = chunked.select(
            "*", *[combine[out](column).over(inside).alias(f"_l_{out}") for out, (_, column) in specs.items()])
        joined = null_safe_join(local, carry, [*self.keys, "_chunk"])
        merged = [
            _merge(kind, F.col(f"_l_{out}"), F.col(f"_c_{out}")).alias(out)
            for out, (kind, _) in specs.items()
        ]
        return self.with_rows(joined.select(*self.rows.columns, *merged))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which NULL keys meet NULL keys; keeps the left side's key columns."""
    named = right.select(*[F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for key in keys:
        condition &= left[key].eqNullSafe(named[f"_right_{key}"])
    joined = left.join(named, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_right_{k}" for k in keys])


COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


def _merge(kind: str, left: Column, right: Column) -> Column:
    """Combine two partial values, either of which may be NULL."""
    if kind == "sum":
        return F.coalesce(left + right, left, right)
    return F.greatest(left, right) if kind == "max" else F.least(left, right)


def ordered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    pos: str = "pos",
    size: str = "track_rows",
    hot_rows: int = HOT_GROUP_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> Ordered:
    """Rank the rows of each group; see the module text for the two plans.

    ``order`` must be total within a group, so that ranks are reproducible.
    """
    hot_groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows)
    listed = hot_groups.limit(MAX_LISTED_GROUPS + 1).collect()
    if not listed:
        return Ordered(_rank_plain(df, keys, order, pos, size), tuple(keys), pos, size, False, chunk_rows)
    if len(listed) <= MAX_LISTED_GROUPS:
        # A short list, small enough for Spark to broadcast.
        hot_groups = df.sparkSession.createDataFrame(listed, hot_groups.schema)
    else:
        hot_groups = materialize(hot_groups)
    n_hot_rows = hot_groups.agg(F.sum("_rows").alias("n")).first().n
    n_ranges = max(
        int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
        -(-n_hot_rows // max(1, hot_rows)) * 2,
    )
    hot_keys = hot_groups.select(*keys)
    rows = _rank_plain(null_safe_join(df, hot_keys, keys, "left_anti"), keys, order, pos, size).unionByName(
        _rank_by_range(null_safe_join(df, hot_keys, keys, "left_semi"), keys, order, pos, size, n_ranges)
    )
    return Ordered(rows, tuple(keys), pos, size, True, chunk_rows)


def _rank_plain(df: DataFrame, keys, order, pos, size) -> DataFrame:
    group = Window.partitionBy(*keys)
    return df.select(
        "*",
        (F.row_number().over(group.orderBy(*order)) - 1).cast("long").alias(pos),
        F.count(F.lit(1)).over(group).alias(size),
    )


def _rank_by_range(df: DataFrame, keys, order, pos, size, n_ranges) -> DataFrame:
    # The range number must be read once and kept: two evaluations of a range
    # shuffle may sample different bounds.
    ranged = materialize(
        df.repartitionByRange(n_ranges, *keys, *order).withColumn("_range", F.spark_partition_id())
    )
    per_range = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    by_range = Window.partitionBy(*keys).orderBy("_range")
    shifts = per_range.select(
        *keys,
        "_range",
        F.coalesce(F.sum("_n").over(by_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias(size),
    )
    local = Window.partitionBy(*keys, "_range").orderBy(*order)
    return (
        null_safe_join(ranged, shifts, [*keys, "_range"])
        .withColumn(pos, (F.row_number().over(local) - 1 + F.col("_before")).cast("long"))
        .select(*df.columns, pos, size)
    )


HASH_PREFIX = 4


def hash_rank(
    df: DataFrame, unit: str, seed: int | str, rank: str = "rank", total: str = "n_units"
) -> DataFrame:
    """Rank distinct units by the SHA-256 of (seed, unit), without a global sort.

    The digest is uniform, so its first hex digits cut the order into 65,536 even
    buckets. Bucket counts are prefix-summed (at most 65,536 rows) and added to
    the rank inside the bucket. (The bucket is made non-null so that no null check
    on the digest is pushed below the DISTINCT, where it would hash every row.)
    """
    units = df.select(unit).distinct().withColumn(
        "_digest", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(unit).cast("string")), 256)
    ).withColumn("_bucket", F.coalesce(F.substring("_digest", 1, HASH_PREFIX), F.lit("")))
    counts = units.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    shifts = counts.select(
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(everything).alias(total),
    )
    local = Window.partitionBy("_bucket").orderBy("_digest", unit)
    # The broadcast side has one row per bucket: 65,536 at most.
    return units.join(F.broadcast(shifts), "_bucket").select(
        unit,
        (F.row_number().over(local) - 1 + F.col("_before")).cast("long").alias(rank),
        F.col(total).cast("long").alias(total),
    )


ROWS_PER_BUCKET = 200_000


def cumulative_by_value(
    hist: DataFrame,
    value: str,
    sums: dict[str, str],
    keys: list[str] | None = None,
    descending: bool = False,
    kind: str = "sum",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Running totals in order of ``value``, without sorting everything in one task.

    ``hist`` has one row per (keys, value): callers group by value first, which
    folds hot ties into one row. A range partitioning cuts the values into even
    buckets; each bucket is summed on its own and shifted by the totals of the
    buckets before it. ``sums`` maps an input column to its running column,
    which excludes the current row itself.

    At every size NULL keys are a group like others, a NULL value sorts below all
    values and a NaN above them.
    """
    keys, combine = keys or [], COMBINE[kind]
    hist = materialize(hist)
    n_buckets = -(-hist.count() // rows_per_bucket)
    if n_buckets > 1:
        # Kept, as two evaluations of a range shuffle may sample different bounds.
        bucketed = materialize(hist.repartitionByRange(n_buckets, value).withColumn("_bucket", F.spark_partition_id()))
    else:
        bucketed = hist.withColumn("_bucket", F.lit(0))
    totals = bucketed.groupBy(*keys, "_bucket").agg(
        *[combine(c).alias(f"_t_{c}") for c in sums]
    )
    direction = F.desc if descending else F.asc
    between = Window.partitionBy(*keys).orderBy(direction("_bucket")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    shifts = totals.select(
        *keys, "_bucket", *[combine(f"_t_{c}").over(between).alias(f"_b_{c}") for c in sums]
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(direction(value)).rowsBetween(
        Window.unboundedPreceding, -1
    )
    local = bucketed.select("*", *[combine(c).over(inside).alias(f"_l_{c}") for c in sums])
    joined = null_safe_join(local, shifts, [*keys, "_bucket"])
    merged = []
    for column, out in sums.items():
        value_before = _merge(kind, F.col(f"_l_{column}"), F.col(f"_b_{column}"))
        merged.append((F.coalesce(value_before, F.lit(0)) if kind == "sum" else value_before).alias(out))
    return joined.select(*hist.columns, *merged)
