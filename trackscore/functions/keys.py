"""Identifiers: image keys, feature keys, store signatures, derived seeds."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FPS
from .boxes import frame_index

# Text layouts of the identifiers and the version numbers that
# are part of a store signature.
IMAGE_NAME = "img_%05d.jpg"
IMAGE_KEY = "%s_%05d"
FEATURE_KEY = "%s|%05d|%.6f|%.6f|%.6f|%.6f"
STORE_FORMAT_VERSION = 1
EXTRACTOR_VERSION = "1"
SEED_SEPARATOR = "\x1f"
SEED_MODULUS = 2**31 - 1


def with_image_key(df: DataFrame) -> DataFrame:
    return df.withColumn("image_key", F.format_string(IMAGE_KEY, "video_id", "frame_idx"))


def video_of_image(key: Column | str) -> Column:
    """The part of an image key before its first underscore."""
    return F.substring_index(key, "_", 1)


def normalize_video_id(df: DataFrame) -> DataFrame:
    """Drop leading zeros: ``"007"`` becomes ``"7"``."""
    return df.withColumn("video_id", F.col("video_id").cast("long").cast("string"))


def with_feature_key(df: DataFrame, fps: int = FPS) -> DataFrame:
    """Identity of one crop: video, frame and the unclamped box."""
    return df.withColumn(
        "key",
        F.format_string(
            FEATURE_KEY, "video_id", frame_index("timestamp", fps), "x1", "y1", "x2", "y2"
        ),
    )


def parse_feature_key(df: DataFrame, key: str = "key") -> DataFrame:
    parts = F.split(F.col(key), r"\|")
    return df.withColumns({
        "video_id": parts[0],
        "frame_idx": parts[1].cast("long"),
        "x1": parts[2].cast("double"),
        "y1": parts[3].cast("double"),
        "x2": parts[4].cast("double"),
        "y2": parts[5].cast("double"),
    })


def store_signature(weights_sha256: str, layer_index: int = 9, input_size: int = 224) -> str:
    """Hash of everything a stored feature depends on; a change opens a new store."""
    canonical = (
        f'{{"extractor_version":"{EXTRACTOR_VERSION}",'
        f'"format_version":{STORE_FORMAT_VERSION},'
        f'"input_size":{int(input_size)},"layer_index":{int(layer_index)},'
        f'"weights_sha256":"{weights_sha256}"}}'
    )
    return hashlib.sha256(canonical.encode()).hexdigest()


def seed_from_parts(*parts) -> int:
    """31-bit seed of a sequence of plain Python values; order matters."""
    text = SEED_SEPARATOR.join(map(repr, parts)).encode("utf-8")
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "big") % SEED_MODULUS


def derive_seed(*columns: Column | str) -> Column:
    """Column form of ``seed_from_parts``, in Arrow batches."""

    @F.pandas_udf("long")
    def seeds(frame: pd.DataFrame) -> pd.Series:
        values = [frame[name].tolist() for name in frame.columns]
        return pd.Series([seed_from_parts(*row) for row in zip(*values)])

    return seeds(F.struct(*columns))
