"""Incremental feature store: extract each key once, look features up by key."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.boxes import filter_actions
from ..functions.keys import with_feature_key
from ..schema import NORMAL_ACTIONS, STORE_SCHEMA

Extractor = Callable[[str], "Sequence[float] | None"]


def read_store(spark: SparkSession, path: str, signature: str, last: int | None = None) -> DataFrame:
    """Rows of one signature; absent means empty. ``last`` leaves out batches published after it."""
    try:
        table = spark.read.schema(STORE_SCHEMA).option("basePath", path).parquet(f"{path}/signature={signature}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        table = spark.createDataFrame([], STORE_SCHEMA)
    if last is not None and "batch" in table.columns:
        table = table.where(F.col("batch") <= last)
    return table.select(*STORE_SCHEMA.names)


class _Folder:
    """The few operations on folders that publication needs, on any file system Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.rename_kind = spark.sparkContext._gateway.new_array(getattr(self.hadoop, "Options$Rename"), 0)
        conf = spark._jsc.hadoopConfiguration()
        self.system = self.hadoop.Path(path).getFileSystem(conf)
        self.context = self.hadoop.FileContext.getFileContext(self.path(path).toUri(), conf)

    def path(self, name: str):
        return self.system.makeQualified(self.hadoop.Path(name))

    def names(self, name: str) -> list[str]:
        where = self.path(name)
        return [f.getPath().getName() for f in self.system.listStatus(where)] if self.system.exists(where) else []

    def move(self, source: str, target: str) -> bool:
        """One atomic rename; False if the target exists."""
        self.system.mkdirs(self.path(target).getParent())
        try:
            self.context.rename(self.path(source), self.path(target), self.rename_kind)
        except Py4JJavaError as error:
            if "exist" not in str(error.java_exception).lower() or not self.system.exists(self.path(source)):
                raise
            return False
        return True

    def remove(self, name: str) -> None:
        self.system.delete(self.path(name), True)


def last_batch(spark: SparkSession, path: str, signature: str) -> int:
    """Number of the newest published batch, 0 if there is none."""
    names = _Folder(spark, path).names(f"{path}/signature={signature}")
    return max((int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")), default=0)


def _staging(path: str) -> str:
    """A folder beside the batches that readers do not look into."""
    return f"{path.rstrip('/')}/_staging/{uuid.uuid4().hex}"


def publish(spark: SparkSession, staged: str, path: str, signature: str, seen: int) -> int:
    """Make the rows of the folder ``staged`` visible in one step; returns how many.

    A batch is a folder that gets its number by an atomic rename, so readers see all of it or
    nothing, and two writers never get the same number. Rows were chosen against the batches up
    to ``seen``: if others have published since, their keys win and are taken out first, so
    a key is stored once whoever writes. What is not published is removed.
    """
    folder, kind = _Folder(spark, path), T.StructType([f for f in STORE_SCHEMA if f.name != "signature"])
    made = [staged]
    try:
        while True:
            newest = last_batch(spark, path, signature)
            if newest > seen:
                taken = read_store(spark, path, signature).select("key")
                made.append(_staging(path))
                spark.read.schema(kind).parquet(staged).join(taken, "key", "left_anti").write.parquet(made[-1])
                staged, seen = made[-1], newest
            n = spark.read.schema(kind).parquet(staged).count()
            if not n or folder.move(staged, f"{path.rstrip('/')}/signature={signature}/batch={seen + 1:09d}"):
                return n
    finally:
        for name in made:
            folder.remove(name)


def append_store(rows: DataFrame, path: str) -> None:
    """Append rows as one new batch per signature; existing files are not rewritten. Keys already stored are left out."""
    spark = rows.sparkSession
    for (signature,) in rows.select("signature").distinct().collect():  # a handful: one per extractor version
        seen, staged = last_batch(spark, path, signature), _staging(path)
        own = rows.where(F.col("signature") == signature)
        own.join(read_store(spark, path, signature, seen).select("key"), "key", "left_anti").select(
            "key", "feature", "valid").write.parquet(staged)
        publish(spark, staged, path, signature, seen)


def missing_keys(keys: DataFrame, store: DataFrame) -> DataFrame:
    """Distinct requested keys the store lacks. Repeats fold before the shuffle."""
    return keys.select("key").distinct().join(store.select("key"), "key", "left_anti")


def key_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("key").subtract(right.select("key"))


def union_store(stored: DataFrame, new: DataFrame) -> DataFrame:
    return stored.unionByName(new)


def lookup_features(keys: DataFrame, store: DataFrame) -> DataFrame:
    """Requested rows with feature and validity; repeats and extra columns stay."""
    return keys.join(store.select("key", "feature", "valid"), "key", "left")


def contains(keys: DataFrame, store: DataFrame) -> DataFrame:
    """Each distinct requested key and whether the store has it."""
    known = store.select("key", F.lit(True).alias("stored"))
    return keys.select("key").distinct().join(known, "key", "left").select(
        "key", F.coalesce("stored", F.lit(False)).alias("stored")
    )


def store_stats(store: DataFrame) -> DataFrame:
    return store.agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.col("valid")).alias("n_valid"),
        F.max(F.when(F.col("valid"), F.size("feature"))).alias("feature_dim"),
    )


def extract_features(keys: DataFrame, extractor: Extractor, signature: str, partitions: int | None = None) -> DataFrame:
    """Run the extractor over distinct keys.

    Keys are tiny and extraction is dear, so the keys are spread over an
    explicit number of partitions that adaptive coalescing leaves alone.
    """
    spark = keys.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = [extractor(key) for key in batch["key"]]
            flat = [
                None if v is None else np.asarray(v, dtype=np.float32).ravel() for v in vectors
            ]
            yield pd.DataFrame({
                "key": batch["key"],
                "feature": pd.Series(flat, dtype=object),
                "valid": [v is not None for v in flat],
                "signature": signature,
            })

    return keys.select("key").repartition(n, "key").mapInPandas(run, STORE_SCHEMA)


def ensure(
    keys: DataFrame,
    store_path: str,
    signature: str,
    extractor: Extractor | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Make every requested key present in the store, then look all of them up.

    Each distinct unseen key is extracted once. The result is staged first: checks read it
    instead of extracting again, a failed check leaves the store as it was, and it becomes
    visible in one step (``publish``), so concurrent and repeated calls store a key once. A key
    without a feature is stored as invalid and never tried again.
    """
    spark = keys.sparkSession
    seen = last_batch(spark, store_path, signature)
    store = read_store(spark, store_path, signature, seen)
    unseen = missing_keys(keys, store)
    if extractor is None:
        absent = unseen.count()
        if absent:
            raise ValueError(f"{absent} requested key(s) have no stored feature; pass an extractor to compute them")
        return lookup_features(keys, store)

    staged = _staging(store_path)
    try:
        extract_features(unseen, extractor, signature, partitions).drop("signature").write.parquet(staged)
        fresh = spark.read.schema(STORE_SCHEMA).parquet(staged)
        width = F.when(F.col("valid"), F.size("feature"))
        new = fresh.agg(
            F.count(F.lit(1)).alias("n"), F.min(width).alias("low"), F.max(width).alias("high")
        ).first()
        if new.n:
            if new.high is None:
                raise RuntimeError(f"none of {new.n} new keys gave a feature")
            known = store.agg(F.max(width).alias("dim")).first().dim
            if new.low != new.high or (known is not None and known != new.high):
                raise ValueError(f"new features have {new.low} to {new.high} components, stored ones {known}")
            publish(spark, staged, store_path, signature, seen)
    finally:
        _Folder(spark, store_path).remove(staged)
    return lookup_features(keys, read_store(spark, store_path, signature))


def valid_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("valid"))


def frame_features(
    df: DataFrame,
    store_path: str,
    signature: str,
    extractor: Extractor | None = None,
    normal_action_ids: Sequence[int] | None = None,
) -> DataFrame:
    """Frame-level feature table: normal rows, keyed, looked up, valid ones kept.

    Duplicate rows stay. No ids given means the default normal actions; an empty
    list keeps nothing, which is an error.
    """
    ids = NORMAL_ACTIONS if normal_action_ids is None else normal_action_ids
    rows = with_feature_key(filter_actions(df.drop("feature", "valid"), ids, empty="none"))
    if rows.isEmpty():
        raise RuntimeError("no rows are left after the action filter")
    return valid_only(ensure(rows, store_path, signature, extractor))


def first_per_key(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of each key's first row (lowest row order wins)."""
    return rows.groupBy("key").agg(
        F.min_by(F.struct(*columns), "row_ord").alias("s")
    ).select("key", *[f"s.{c}" for c in columns])
