"""Incremental feature store fed by a stream of annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Extractor, ensure


def start_feature_stream(
    keys: DataFrame,
    store_path: str,
    signature: str,
    extractor: Extractor,
    checkpoint: str,
    event_time: str | None = None,
    delay: str = "10 minutes",
    progress: str | None = None,
) -> StreamingQuery:
    """Extract the new keys of every micro-batch into the store.

    ``keys`` is a stream with a ``key`` column. With an event-time column repeats within the
    delay are dropped in state, over triggers and restarts, before they reach a batch; rows
    later than the watermark are dropped too. Keys already stored are never extracted again,
    so a replayed batch adds nothing. ``progress`` names a table that gets a row (batch_id,
    n_keys) per micro-batch, written under the batch's number: a replay writes it again.
    """
    if event_time:
        keys = keys.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["key"])

    def absorb(batch: DataFrame, batch_id: int) -> None:
        found = batch.select("key").where(F.col("key").isNotNull())
        if progress:
            found = found.persist()
            found.agg(F.count(F.lit(1)).alias("n_keys")).select(F.lit(batch_id).alias("batch_id"), "n_keys").write.mode(
                "overwrite").parquet(f"{progress.rstrip('/')}/part={batch_id}")
        ensure(found, store_path, signature, extractor)
        if progress:
            found.unpersist()

    return (
        keys.writeStream.foreachBatch(absorb)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
