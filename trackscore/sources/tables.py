"""Fitted state, history, ledgers and score tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..schema import HISTORY_COLUMNS, SCALER_SCHEMA, require_columns

SCORE_KEYS = ["model", "setting", "split", "seed"]


def write_scaler(state: DataFrame, path: str) -> None:
    state.select(*SCALER_SCHEMA.names).write.mode("overwrite").parquet(path)


def read_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCALER_SCHEMA).parquet(path)


def write_history(history: DataFrame, path: str) -> None:
    """History as CSV in the canonical column order; absent columns are an error."""
    require_columns(history, HISTORY_COLUMNS, "history")
    history.select(*HISTORY_COLUMNS).orderBy("epoch").coalesce(1).write.mode("overwrite").csv(
        path, header=True
    )


def write_ledger(entries: DataFrame, path: str) -> None:
    """Append ledger rows as JSON lines."""
    entries.write.mode("append").json(path)


def read_ledger(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Ledger rows; an absent ledger is empty and corrupt lines are dropped."""
    corrupt = "_corrupt_record"
    wide = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)
    parsed = lines.select(F.from_json(
        "value", wide, {"columnNameOfCorruptRecord": corrupt}).alias("entry"))
    return parsed.where(F.col(f"entry.{corrupt}").isNull()).select(
        *[F.col(f"entry.{name}") for name in schema.names])


def write_scores(scores: DataFrame, path: str) -> None:
    """Scores by (model, setting, split, seed), so reports need no refit."""
    require_columns(scores, SCORE_KEYS, "scores")
    scores.write.mode("append").partitionBy(*SCORE_KEYS).parquet(path)


def results_index(scores: DataFrame) -> DataFrame:
    """One row per run key with its row count and score range."""
    return scores.groupBy(*SCORE_KEYS).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
    )
