"""The corpus pipeline: stages applied to ``documents`` one after another.

Each stage gets the documents that its predecessor kept, works on all of them and returns
the columns of ``documents``; the last one returns token ids too. Stages are written as
Parquet in between, so a lost executor costs no more than the running stage.

Null and empty texts pass all stages; rows with a null doc_id are kept but for toxicity and
benchmark leaks, which are judged by the text alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackscore.llm import chains, pairbpe, pathjoin, templates, windows
from trackscore.llm.queries import toxicity_chain, vocabulary_path
from trackscore.session import scratch_path


def _written(frame: DataFrame, label: str) -> DataFrame:
    """A small result as a table, so that its size is known to the join that uses it."""
    path = scratch_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain does not call toxic."""
    scored = chains.score(docs, toxicity_chain(spark, sf_dir, docs))
    return scored.where(~F.col("is_toxic")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each near-duplicate group (five-word shingles, 0.8)."""
    groups = pathjoin.near_duplicates(docs, width=5, percent=80)
    copies = _written(groups.where(~F.col("kept")).select("doc_id").distinct(), "copies")
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = windows.remove_repeats(docs, carry=others)
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", length).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = templates.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return templates.without_leaks(docs, _written(leaks.select("row").distinct(), "leaks")).select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, and a digest of the ids' decoding."""
    coded = pairbpe.encode(docs, vocabulary_path())
    return coded.withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: The toxicity model and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written to the shared folder and read by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
