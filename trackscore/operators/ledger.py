"""Provenance as tables: artifacts, configurations, steps, staleness."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import as_uri, list_files
from .fingerprint import entry_text, hash_tree
from .ordering import CHUNK_ROWS, HOT_GROUP_ROWS, ordered


PIECE = 1 << 20


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Content hashes of files, read in pieces, so a file may have any size."""
    from pyarrow import fs

    for batch in batches:
        hashes = []
        for path in batch.column("found").to_pylist():
            system, inner = fs.FileSystem.from_uri(as_uri(path))
            digest = hashlib.sha256()
            with system.open_input_stream(inner, compression=None) as data:
                while piece := data.read(PIECE):
                    digest.update(piece)
            hashes.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, pa.string())], names=[*batch.schema.names, "sha256"])


def artifact_ledger(spark: SparkSession, wanted: DataFrame, path: str) -> DataFrame:
    """Content hash and size of each wanted (name, path); absent files are marked.

    Only the listing of the folder is read to find the wanted files, and only those are
    hashed.
    """
    listed = list_files(spark, path).select(
        F.regexp_replace("path", r"^file:/*", "/").alias("path"), F.col("path").alias("found"), F.col("length").alias("bytes"))
    paths = wanted.select("path").distinct().join(listed, "path")
    # A fixed number: rows are tiny, and adaptive execution would put all files into one task.
    spread = paths.repartition(4 * spark.sparkContext.defaultParallelism, "path")
    hashed = spread.mapInArrow(_digests, "path string, found string, bytes long, sha256 string")
    return wanted.join(hashed, "path", "left").select(
        "name", "path", "sha256", "bytes", F.col("sha256").isNull().alias("missing")
    )


def config_hash(config: DataFrame) -> DataFrame:
    """Hash per run of its (key, value) entries, whatever their order."""
    return hash_tree(config, entry_text("key", "value"), ["run_id"]).select(
        "run_id", F.col("sha256").alias("config_hash"), F.col("n_items").alias("n_keys")
    )


def config_diff(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Entries that were added, removed or changed between two configurations."""
    left = old.select(*by, "key", F.col("value").alias("old_value"), F.lit(True).alias("_old"))
    right = new.select(*by, "key", F.col("value").alias("new_value"), F.lit(True).alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), F.lit("added"))
        .when(F.col("_new").isNull(), F.lit("removed"))
        .when(~F.col("old_value").eqNullSafe(F.col("new_value")), F.lit("changed"))
    )
    return (
        left.join(right, [*by, "key"], "full_outer")
        .select(*by, "key", "old_value", "new_value", change.alias("change"))
        .where(F.col("change").isNotNull())
    )


def current_steps(steps: DataFrame) -> DataFrame:
    """The latest entry per (run, step); repeats fold before the shuffle."""
    fields = [c for c in steps.columns if c not in ("run_id", "step")]
    order = [c for c in ("completed_at", "entry_ord") if c in fields]
    return steps.groupBy("run_id", "step").agg(
        F.max_by(F.struct(*fields), F.struct(*order)).alias("_latest")
    ).select("run_id", "step", "_latest.*")


def step_verdicts(outputs: DataFrame, steps: DataFrame, configs: DataFrame) -> DataFrame:
    """May each step's output be reused?

    ``missing``: no output. ``reuse``: no configuration was supplied (existence
    is all that counts), or the recorded hashes equal the current ones.
    ``unverified``: an output without a ledger entry. ``stale``: a recorded
    configuration or weights hash differs.
    """
    entry = current_steps(steps).select(
        "run_id", "step",
        F.col("config_hash").alias("recorded_config"),
        F.col("weights_sha256").alias("recorded_weights"),
        F.lit(True).alias("has_entry"),
    )
    joined = outputs.join(entry, ["run_id", "step"], "left").join(configs, "run_id", "left")
    other_weights = F.col("recorded_weights").isNotNull() & ~F.col("recorded_weights").eqNullSafe(
        F.col("weights_sha256"))
    verdict = (
        F.when(~F.col("output_exists"), F.lit("missing"))
        .when(F.col("config_hash").isNull(), F.lit("reuse"))
        .when(F.col("has_entry").isNull(), F.lit("unverified"))
        .when(other_weights, F.lit("stale"))
        .when(F.col("recorded_config").eqNullSafe(F.col("config_hash")), F.lit("reuse"))
        .otherwise(F.lit("stale"))
    )
    return joined.select("run_id", "step", verdict.alias("verdict"))


def previous_runs(
    runs: DataFrame, hot_rows: int = HOT_GROUP_ROWS, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """The run before each run of a directory, where its configuration differed."""
    chain = ordered(runs, ["run_id"], ["started_at", "entry_ord"], size="n_runs",
                    hot_rows=hot_rows, chunk_rows=chunk_rows)
    chain = chain.over_neighbours(
        1, 0, {"previous": lambda w: F.lag(F.struct("config_hash", "started_at")).over(w)})
    return chain.rows.where(F.col("previous.config_hash") != F.col("config_hash")).select(
        "run_id", "entry_ord", "started_at", "config_hash",
        F.col("previous.config_hash").alias("previous_hash"),
        F.col("previous.started_at").alias("previous_at"),
    )
