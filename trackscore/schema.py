"""Column layouts shared by sources, operators and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The positional layout of a headerless annotation file, the
# frame rate, and the history columns every model reports.
ANNOTATION_COLUMNS = ["video_id", "timestamp", "x1", "y1", "x2", "y2", "action_id", "target_id"]
FPS = 25
NORMAL_ACTIONS = (0, 1, 2)
HISTORY_COLUMNS = [
    "epoch", "train_loss", "train_recon", "train_kl", "val_loss", "val_recon", "val_kl",
]

ANNOTATION_FILE_SCHEMA = T.StructType([
    T.StructField("video_id", T.StringType()),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("x1", T.DoubleType()),
    T.StructField("y1", T.DoubleType()),
    T.StructField("x2", T.DoubleType()),
    T.StructField("y2", T.DoubleType()),
    T.StructField("action_id", T.IntegerType()),
    T.StructField("target_id", T.IntegerType()),
])

STORE_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("feature", T.ArrayType(T.FloatType())),
    T.StructField("valid", T.BooleanType()),
    T.StructField("signature", T.StringType()),
])

SCALER_SCHEMA = T.StructType([
    T.StructField("scaler_id", T.StringType()),
    T.StructField("dim", T.IntegerType()),
    T.StructField("a", T.DoubleType()),
    T.StructField("b", T.DoubleType()),
])

TRACK = ["video_id", "target_id"]
WINDOW = ["video_id", "target_id", "start"]


def require_columns(df: DataFrame, names: list[str], what: str) -> None:
    """Fail early, naming every absent column."""
    absent = [name for name in names if name not in df.columns]
    if absent:
        raise ValueError(f"{what} needs {absent}, which it does not have")
