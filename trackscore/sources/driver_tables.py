"""The shared analytics tables, seen as track data.

``events`` becomes annotations (a user is one target of a video, the event type
is the action, boxes come from arithmetic on the event id so that some leave the
image and some are degenerate) and ``embeddings`` becomes feature vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# How event types stand for actions, and the DuckDB text of the
# same view.
ACTION_OF_EVENT = {"click": 0, "error": 1, "purchase": 2, "signup": 3}
OTHER_ACTION = 4
NORMAL_LABEL_MAX = 2

ANNOTATIONS_SQL = """annotations AS (
  SELECT CAST(user_id // 3 AS VARCHAR) AS video_id,
    CAST(event_id - event_id % 4 AS DOUBLE) * CAST(0.04 AS DOUBLE) AS timestamp,
    CAST((event_id*7)%110 AS DOUBLE)/100 - CAST(0.05 AS DOUBLE) AS x1,
    CAST((event_id*11)%110 AS DOUBLE)/100 - CAST(0.05 AS DOUBLE) AS y1,
    CAST((event_id*7)%110 + (event_id*13)%40 - 4 AS DOUBLE)/100 - CAST(0.05 AS DOUBLE) AS x2,
    CAST((event_id*11)%110 + (event_id*17)%50 - 3 AS DOUBLE)/100 - CAST(0.05 AS DOUBLE) AS y2,
    CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2
                    WHEN 'signup' THEN 3 ELSE 4 END AS action_id,
    CAST(user_id % 3 AS INT) AS target_id,
    event_id AS row_ord,
    event_id % greatest(1, (SELECT count(*) FROM embeddings)) AS vec_id,
    event_id % 11 <> 0 AS valid,
    event_id % 13 <> 0 AS has_frame
  FROM events)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_count(spark: SparkSession, sf_dir: str) -> int:
    """Number of stored vectors, which events refer to in turn (read from file footers, at every call)."""
    return max(1, table(spark, sf_dir, "embeddings").count())


def annotations(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return annotation_view(table(spark, sf_dir, "events"), vector_count(spark, sf_dir), *extra)


def annotation_view(events: DataFrame, vectors: int, *extra: str) -> DataFrame:
    """Annotation columns of an events table or stream; ``extra`` columns pass through.

    Row i refers to vector i modulo ``vectors``, so every vector is used and none is hot.
    """
    event = F.col("event_id")

    def hundredths(value):
        return value.cast("double") / F.lit(100) - F.lit(0.05)

    left, top = (event * 7) % 110, (event * 11) % 110
    action = F.lit(OTHER_ACTION)
    for name, number in ACTION_OF_EVENT.items():
        action = F.when(F.col("event_type") == name, F.lit(number)).otherwise(action)
    return events.select(
        F.floor(F.col("user_id") / 3).cast("string").alias("video_id"),
        ((event - event % 4).cast("double") * F.lit(0.04)).alias("timestamp"),
        hundredths(left).alias("x1"),
        hundredths(top).alias("y1"),
        hundredths(left + (event * 13) % 40 - 4).alias("x2"),
        hundredths(top + (event * 17) % 50 - 3).alias("y2"),
        action.cast("int").alias("action_id"),
        (F.col("user_id") % 3).cast("int").alias("target_id"),
        event.alias("row_ord"),
        (event % F.lit(vectors).cast("long")).alias("vec_id"),
        (event % 11 != 0).alias("valid"),
        (event % 13 != 0).alias("has_frame"),
        *extra,
    )


def frames(rows: DataFrame) -> DataFrame:
    """Frames on disk: distinct (video, frame) of the rows that have one."""
    from ..functions.boxes import frame_index

    return (
        rows.where("has_frame")
        .select("video_id", frame_index("timestamp").alias("frame_idx"))
        .distinct()
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").alias("feature"), "label"
    )
