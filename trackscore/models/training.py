"""Data-parallel training and scoring of the reconstruction models.

Each epoch is one Spark job: every task takes the current parameters, runs
mini-batch Adam over its own rows and emits its parameters in blocks; blocks are
averaged (weighted by rows) across tasks by ordinary aggregation. The driver
only ever holds one set of parameters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import seed_from_parts
from ..schema import HISTORY_COLUMNS
from ..session import materialize
from .kernels import FlatVAE, Kernel, SequenceVAE, initial_weights, pack, unpack

BLOCK = 16_384
BETA1, BETA2, ADAM_EPS = 0.9, 0.999, 1e-8
LOSS_SCHEMA = (
    "model string, epoch int, split string, loss double, recon double, kl double, "
    "n_batches long, n_rows long, n_elements long"
)


def prepare(rows: DataFrame, unit: str, column: str, partitions: int) -> DataFrame:
    """Fix the rows of every task: training then repeats bit for bit."""
    placed = rows.select(unit, column).repartition(partitions, unit).sortWithinPartitions(unit)
    return materialize(placed.select(column, F.spark_partition_id().alias("part")))


def _batches(stream: Iterator[pa.RecordBatch], kernel: Kernel, size: int, rng):
    """Mini-batches of exactly ``size`` rows (the last may be shorter)."""
    rest = None
    for record in stream:
        if not record.num_rows:
            continue
        x = kernel.read(record.column(0))
        x = x[rng.permutation(len(x))]
        rest = x if rest is None else np.concatenate([rest, x])
        while len(rest) >= size:
            yield rest[:size]
            rest = rest[size:]
    if rest is not None and len(rest):
        yield rest


def _pass(data: DataFrame, kernel: Kernel, state, epoch: int, size: int, seed: int, lr: float | None):
    """One pass over the rows. With ``lr`` parameters are trained, else only scored."""
    shared = data.sparkSession.sparkContext.broadcast(state)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, first, second, t = shared.value
        vector, first, second = vector.copy(), first.copy(), second.copy()
        sums, rng = np.zeros(6), None

        def tagged():
            nonlocal rng
            for record in stream:
                if rng is None and record.num_rows:
                    part = record.column(1)[0].as_py()
                    rng = np.random.default_rng(seed_from_parts(seed, epoch, part, lr is None))
                yield record

        source = tagged()
        head = next(source, None)
        if head is None:
            return

        def whole():
            yield head
            yield from source

        for x in _batches(whole(), kernel, size, rng or np.random.default_rng(seed)):
            eps = rng.standard_normal((len(x), kernel.latent_dim))
            recon, kl, grads = kernel.step(unpack(kernel, vector), x, eps)
            sums += [recon + kl, recon, kl, 1, len(x), x.size]
            if lr is not None:
                t += 1
                g = pack(kernel, grads)
                first += (1 - BETA1) * (g - first)
                second += (1 - BETA2) * (np.square(g) - second)
                vector -= lr * (first / (1 - BETA1**t)) / (
                    np.sqrt(second / (1 - BETA2**t)) + ADAM_EPS)
        if not sums[4]:
            return
        rows = [(-1, sums.tolist(), 1.0)]
        if lr is not None:
            everything = np.concatenate([vector, first, second, [t]])
            rows += [
                (b, everything[at:at + BLOCK].tolist(), float(sums[4]))
                for b, at in enumerate(range(0, len(everything), BLOCK))
            ]
        block, values, weight = zip(*rows)
        yield pa.RecordBatch.from_pydict({
            "block": pa.array(block, pa.int32()),
            "values": pa.array(values, pa.list_(pa.float64())),
            "weight": pa.array(weight, pa.float64()),
        })

    emitted = data.mapInArrow(run, "block int, values array<double>, weight double")
    merged = emitted.groupBy("block").agg(
        Summarizer.metrics("mean", "sum").summary(array_to_vector("values"), F.col("weight")).alias("s"))
    rows = merged.select(
        "block",
        F.when(F.col("block") < 0, vector_to_array("s.sum")).otherwise(vector_to_array("s.mean")).alias("v"),
    ).collect()
    shared.destroy()
    return {r.block: np.array(r.v) for r in rows}


def fit(
    rows: DataFrame,
    kernel: Kernel,
    unit: str,
    column: str = "feature",
    epochs: int = 50,
    batch_size: int | None = None,
    lr: float = 1e-3,
    seed: int = 42,
    partitions: int = 8,
) -> tuple[np.ndarray, DataFrame]:
    """Train on rows of fold ``train``, watch fold ``val``: (weights, loss sums)."""
    spark = rows.sparkSession
    name = "flat_vae" if isinstance(kernel, FlatVAE) else "sequence_vae"
    batch_size = batch_size or (64 if isinstance(kernel, FlatVAE) else 32)
    train = prepare(rows.where(F.col("fold") == "train"), unit, column, partitions)
    val = prepare(rows.where(F.col("fold") == "val"), unit, column, partitions)
    vector = initial_weights(kernel, seed)
    state = (vector, np.zeros_like(vector), np.zeros_like(vector), 0.0)
    losses = []
    for epoch in range(1, epochs + 1):
        merged = _pass(train, kernel, state, epoch, batch_size, seed, lr)
        if -1 not in merged:
            raise ValueError("there are no training rows")
        losses.append((name, epoch, "train", *_loss_fields(merged[-1])))
        flat = np.concatenate([merged[b] for b in sorted(merged) if b >= 0])
        n = len(vector)
        state = (flat[:n], flat[n:2 * n], flat[2 * n:3 * n], float(flat[-1]))
        checked = _pass(val, kernel, state, epoch, batch_size, seed, None)
        losses.append((name, epoch, "val", *_loss_fields(checked.get(-1, np.zeros(6)))))
    return state[0], spark.createDataFrame(losses, LOSS_SCHEMA)


def _loss_fields(sums: np.ndarray):
    return (*[float(v) for v in sums[:3]], *[int(v) for v in sums[3:6]])


def fit_vae(rows: DataFrame, unit: str, input_dim: int, hidden_dim: int = 128, latent_dim: int = 32, **options):
    kernel = FlatVAE(input_dim, hidden_dim, latent_dim)
    weights, losses = fit(rows, kernel, unit, **options)
    return kernel, weights, losses


def fit_sequence_vae(windows: DataFrame, unit: str, input_dim: int, hidden_dim: int = 128, latent_dim: int = 32, **options):
    kernel = SequenceVAE(input_dim, hidden_dim, latent_dim)
    weights, losses = fit(windows, kernel, unit, **options)
    return kernel, weights, losses


def reduce_losses(losses: DataFrame, divisor: str = "batches") -> DataFrame:
    """Loss sums of batches to one value per (model, epoch, split).

    ``batches`` divides by the batch count (the flat model's report), ``dataset``
    by the rows of all splits (the sequence model's), ``rows`` by the split's own
    rows and ``elements`` by its vector elements, which makes models comparable.
    """
    sums = losses.groupBy("model", "epoch", "split").agg(*[
        F.sum(c).alias(c) for c in ("loss", "recon", "kl", "n_batches", "n_rows", "n_elements")])
    if divisor == "dataset":
        sizes = losses.groupBy("model", "epoch").agg(F.sum("n_rows").alias("_by"))
        sums = sums.join(sizes, ["model", "epoch"])
        by = F.col("_by")
    else:
        by = F.col({"batches": "n_batches", "rows": "n_rows", "elements": "n_elements"}[divisor])
    return sums.select(
        "model", "epoch", "split",
        *[F.when(by > 0, F.col(c) / by).alias(c) for c in ("loss", "recon", "kl")])


def history_frame(reduced: DataFrame) -> DataFrame:
    """One row per (model, epoch) with the canonical history columns."""
    values = [
        F.max(F.when(F.col("split") == split, F.col(term))).alias(f"{split}_{term}")
        for split in ("train", "val") for term in ("loss", "recon", "kl")
    ]
    return reduced.groupBy("model", "epoch").agg(*values).select("model", *HISTORY_COLUMNS)


def score_model(df: DataFrame, kernel: Kernel, weights: np.ndarray, column: str = "feature") -> DataFrame:
    """Add ``mu``, ``logvar`` and ``score`` (squared error from the mean latent)."""
    shared = df.sparkSession.sparkContext.broadcast(weights)
    z = kernel.latent_dim

    @F.arrow_udf("array<double>")
    def run(values: pa.Array) -> pa.Array:
        if len(values) == 0:
            return pa.array([], pa.list_(pa.float64()))
        x = kernel.read(values)
        recon, mu, logvar = kernel.forward(unpack(kernel, shared.value), x)
        error = np.square(recon - x).reshape(len(x), -1).sum(axis=1, keepdims=True)
        joined = np.hstack([error, mu, logvar])
        offsets = np.arange(len(joined) + 1, dtype=np.int32) * joined.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(joined.ravel()))

    return df.withColumn("_m", run(column)).withColumns({
        "score": F.col("_m")[0],
        "mu": F.slice("_m", 2, z),
        "logvar": F.slice("_m", 2 + z, z),
    }).drop("_m")


def vae_loss_terms(df: DataFrame) -> DataFrame:
    """Per row: squared error, KL term and their sum, from ``feature``,
    ``reconstruction``, ``mu`` and ``logvar`` arrays."""

    def total(items):
        return F.aggregate(items, F.lit(0.0), lambda a, x: a + x)

    errors = F.zip_with("feature", "reconstruction", lambda x, r: F.pow(x.cast("double") - r.cast("double"), F.lit(2.0)))
    latent = F.zip_with("mu", "logvar", lambda m, v: (
        F.lit(1.0) + v.cast("double") - F.pow(m.cast("double"), F.lit(2.0)) - F.exp(v.cast("double"))))
    return df.withColumns({"recon": total(errors), "kl": F.lit(-0.5) * total(latent)}).withColumn(
        "loss", F.col("recon") + F.col("kl"))
