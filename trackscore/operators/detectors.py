"""Distance, reconstruction, tree and prediction scores over feature vectors.

Every ``fit_*`` is one or two distributed aggregations that return a state of
D or D x D numbers; every score is one Arrow-batched column expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spectral import RANK_TOLERANCE, eigen, spectral_inverse
from ..functions.vectors import row_function, squared_distance, to_matrix
from .ordering import Ordered
from .scaling import EPS, dimension_stats


@dataclass(frozen=True)
class Gaussian:
    """Mean, covariance (divided by n), row count and the mean fourth power of the norm."""

    mean: np.ndarray
    covariance: np.ndarray
    n: int
    fourth: float


def fit_mean(df: DataFrame, column: str = "feature") -> np.ndarray:
    rows = dimension_stats(df, column).select("dim", "mean").collect()
    if not rows:
        raise ValueError("no rows to fit on")
    return np.array([r.mean for r in sorted(rows)])


def fit_diagonal(df: DataFrame, column: str = "feature") -> tuple[np.ndarray, np.ndarray]:
    """Mean and population variance per dimension."""
    rows = sorted(dimension_stats(df, column).select("dim", "mean", "variance").collect())
    return np.array([r.mean for r in rows]), np.array([r.variance for r in rows])


def gram(df: DataFrame, width: int, column: str = "feature") -> DataFrame:
    """Power sums of the vectors as rows (i, row), from one pass.

    Rows 0.. are the Gram matrix; row -1 is the sum, row -2 the sum of
    |x|^2 x, row -3 is [n, sum of |x|^4]. Each task folds its rows into one
    matrix; matrix rows are then added up across tasks by row number, so no
    reducer sees whole matrices.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, fourth = np.zeros((width, width)), 0, 0.0
        first, third = np.zeros(width), np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                x = to_matrix(batch.column(0))
                norms = np.square(x).sum(axis=1)
                total += x.T @ x
                first += x.sum(axis=0)
                third += norms @ x
                n += len(x)
                fourth += float(np.square(norms).sum())
        if n:
            rows = [[float(n), fourth], third.tolist(), first.tolist(), *total.tolist()]
            yield pa.RecordBatch.from_pydict(
                {"i": pa.array(range(-3, width), pa.int32()), "row": pa.array(rows, pa.list_(pa.float64()))}
            )

    partials = df.where(F.col(column).isNotNull()).select(column).mapInArrow(partial, "i int, row array<double>")
    return partials.groupBy("i").agg(
        vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row"))


def fit_gaussian(df: DataFrame, width: int, column: str = "feature") -> Gaussian:
    """Mean, covariance and centred fourth moment from the power sums."""
    rows = {r.i: np.array(r.row) for r in gram(df, width, column).collect()}
    if not rows:
        raise ValueError("no rows to fit on")
    n, fourth = rows[-3]
    mean, third = rows[-1] / n, rows[-2] / n
    raw = np.array([rows[i] for i in range(width)]) / n
    square = mean @ mean
    centred = (
        fourth / n + 4 * mean @ raw @ mean + square**2 - 4 * mean @ third
        + 2 * square * np.trace(raw) - 4 * square**2)
    return Gaussian(mean, raw - np.outer(mean, mean), int(n), float(centred))


def covariance_table(spark, state: Gaussian) -> DataFrame:
    """Covariance entries (i, j, cov): D x D numbers of fitted state."""
    width = len(state.mean)
    rows = [(i, j, float(state.covariance[i, j])) for i in range(width) for j in range(width)]
    return spark.createDataFrame(rows, "i int, j int, cov double")


def ridge(state: Gaussian, strength: float = 1e-3) -> np.ndarray:
    """Covariance plus a share of its mean variance on the diagonal."""
    width = len(state.mean)
    return state.covariance + strength * np.trace(state.covariance) / width * np.eye(width)


def shrunk(state: Gaussian) -> tuple[np.ndarray, float]:
    """Ledoit-Wolf shrinkage toward a scaled identity; returns (covariance, weight)."""
    s, width = state.covariance, len(state.mean)
    scale = np.trace(s) / width
    spread = np.square(s - scale * np.eye(width)).sum()
    noise = (state.fourth - np.square(s).sum()) / state.n
    weight = float(np.clip(noise / spread, 0.0, 1.0)) if spread > 0 else 0.0
    return (1 - weight) * s + weight * scale * np.eye(width), weight


def euclidean_score(mean: np.ndarray, column: str | Column = "feature") -> Column:
    return squared_distance(column, mean)


def diagonal_score(mean, variance, column: str | Column = "feature") -> Column:
    scale = np.asarray(variance) + EPS
    return row_function(lambda x: (np.square(x - mean) / scale).sum(axis=1), column)


def mahalanobis_score(mean, covariance, column: str | Column = "feature") -> Column:
    """Squared Mahalanobis distance; of a singular covariance the directions without variance are left out."""
    precision = spectral_inverse(covariance)

    def score(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return np.einsum("ij,ij->i", centred @ precision, centred)

    return row_function(score, column)


def condition_numbers(spark, state: Gaussian) -> DataFrame:
    """Spectrum of each covariance variant, one ledger row each.

    ``rank`` counts the eigenvalues above the rank tolerance, ``condition`` is the ratio of
    the largest to the smallest of all (NULL if the matrix is singular), ``kept_condition``
    that of the counted ones.
    """
    variants = {
        "diagonal": np.diag(np.diag(state.covariance)),
        "full": state.covariance,
        "ridge": ridge(state),
        "shrunk": shrunk(state)[0],
    }
    rows = []
    for name, matrix in variants.items():
        values, _ = eigen(matrix)
        kept = values[values > RANK_TOLERANCE * max(values[0], 0.0)]
        ratio = float(kept[0] / kept[-1]) if len(kept) else None
        rows.append((name, len(kept), ratio if len(kept) == len(values) else None, ratio))
    return spark.createDataFrame(rows, "variant string, rank int, condition double, kept_condition double")


@dataclass(frozen=True)
class Components:
    mean: np.ndarray
    axes: np.ndarray  # (D, k), columns by falling variance
    variances: np.ndarray


def principal_components(state: Gaussian, k: int) -> Components:
    values, vectors = eigen(state.covariance)
    return Components(state.mean, vectors[:k].T, values[:k])


def pca_euclidean_score(pca: Components, column: str | Column = "feature") -> Column:
    return row_function(lambda x: np.square((x - pca.mean) @ pca.axes).sum(axis=1), column)


def pca_mahalanobis_score(pca: Components, column: str | Column = "feature") -> Column:
    return row_function(
        lambda x: (np.square((x - pca.mean) @ pca.axes) / (pca.variances + EPS)).sum(axis=1), column)


def linear_autoencoder_score(pca: Components, column: str | Column = "feature") -> Column:
    """Squared error of projecting onto the components and back."""

    def error(x: np.ndarray) -> np.ndarray:
        centred = x - pca.mean
        return np.square(centred - centred @ pca.axes @ pca.axes.T).sum(axis=1)

    return row_function(error, column)


# --- isolation forest ------------------------------------------------------

TREE_SCHEMA = "tree int, node int, dim int, cut double, size long"
TREES, COPIES, LEVELS = 32, 4, 8


def drawn(*parts) -> int:
    """60 bits of the SHA-256 of the parts."""
    return int(hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def grow_forest(
    df: DataFrame, unit: str, width: int, column: str = "feature", n_trees: int = TREES, copies: int = COPIES,
    levels: int = LEVELS, seed: int = 42,
) -> DataFrame:
    """Isolation trees over all rows, as a node table; children of node k are 2k+1 and 2k+2.

    A hash gives every row to ``copies`` of the trees. Trees grow level by level: a node's
    dimension and the place of its cut are drawn by hash, and one partially aggregated
    count with minimum and maximum per node decides the cut. Nodes of one row, of one
    value or at the last level are leaves (dim -1). What the driver holds are at most
    n_trees * 2**(levels + 1) nodes. Rows without a vector take no part.
    """
    spark = df.sparkSession
    home = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(unit).cast("string")), 256), 1, 15), 16, 10).cast("long")
    step = max(1, n_trees // copies)
    rows = df.where(F.col(column).isNotNull()).select(
        column, F.explode(F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda k: F.pmod(home + k * step, F.lit(n_trees))
                                      .cast("int"))).alias("tree")).withColumn("node", F.lit(0))
    frontier = [(tree, 0) for tree in range(n_trees)]
    nodes = []
    for level in range(levels + 1):
        named = [(t, n, drawn(seed, t, n, "dim") % width) for t, n in frontier]
        table = spark.createDataFrame(named, "tree int, node int, dim int")
        valued = rows.join(F.broadcast(table), ["tree", "node"]).withColumn(
            "value", F.element_at(column, F.col("dim") + 1).cast("double"))
        found = valued.groupBy("tree", "node", "dim").agg(
            F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect()
        inner = []
        for r in found:
            if level == levels or r.n <= 1 or not r.low < r.high:
                nodes.append((r.tree, r.node, -1, 0.0, r.n))
            else:
                cut = r.low + drawn(seed, r.tree, r.node, "cut") / 16.0**15 * (r.high - r.low)
                inner.append((r.tree, r.node, r.dim, cut, r.n))
        nodes += inner
        if not inner:
            break
        cuts = spark.createDataFrame([x[:4] for x in inner], "tree int, node int, dim int, cut double")
        rows = rows.join(F.broadcast(cuts), ["tree", "node"]).select(
            column, "tree",
            (F.col("node") * 2 + 1 + (F.element_at(column, F.col("dim") + 1).cast("double") > F.col("cut")).cast("int")).alias("node"))
        frontier = [(t, 2 * n + side) for t, n, *_ in inner for side in (1, 2)]
    if not nodes:
        raise ValueError("no rows to grow trees from")
    return spark.createDataFrame(nodes, TREE_SCHEMA)


def _expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=np.float64)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def forest_score(nodes: DataFrame, column: str | Column = "feature") -> Column:
    """Isolation score in (0, 1]. The node table is bounded by trees and sample size."""
    table = nodes.orderBy("tree", "node").toPandas()
    trees = []
    for _, group in table.groupby("tree"):
        width = int(group["node"].max()) + 1
        dim, cut, size = np.full(width, -1), np.zeros(width), np.zeros(width)
        at = group["node"].to_numpy()
        dim[at], cut[at], size[at] = group["dim"], group["cut"], group["size"]
        trees.append((dim, cut, size))
    usual = float(_expected_path(max(t[2][0] for t in trees)))

    def score(x: np.ndarray) -> np.ndarray:
        paths = np.zeros(len(x))
        rows = np.arange(len(x))
        for dim, cut, size in trees:
            node, depth = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
            while True:
                inner = dim[node] >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(dim[node], 0)] > cut[node]
                node = np.where(inner, 2 * node + 1 + right, node)
                depth += inner
            paths += depth + _expected_path(size[node])
        return np.power(2.0, -paths / len(trees) / max(usual, 1e-12))

    return row_function(score, column)


# --- next-step prediction --------------------------------------------------


@dataclass(frozen=True)
class Predictor:
    """Linear map from the last k vectors to the next one."""

    weights: np.ndarray  # (k*D, D)
    mean: np.ndarray  # over [history, next]
    steps: int


def with_history(track: Ordered, steps: int, column: str = "feature") -> DataFrame:
    """Rows with at least ``steps`` predecessors; adds ``joint`` = [oldest .. previous, own]."""
    names = [f"_lag{k}" for k in range(steps, 0, -1)]
    lagged = track.over_neighbours(
        steps, 0,
        {f"_lag{k}": (lambda w, k=k: F.lag(column, k).over(w)) for k in range(steps, 0, -1)},
    )
    return (
        lagged.rows.where(F.col("pos") >= steps)
        .withColumn("joint", F.concat(*names, F.col(column)))
        .drop(*names)
    )


def fit_predictor(history: DataFrame, steps: int, width: int, strength: float = 1e-2) -> Predictor:
    """Ridge regression of the next vector on the previous ones, from one Gram matrix."""
    state = fit_gaussian(history, width * (steps + 1), "joint")
    known = steps * width
    inner = state.covariance[:known, :known]
    penalty = strength * np.trace(inner) / known * np.eye(known)
    weights = np.linalg.solve(inner + penalty, state.covariance[:known, known:])
    return Predictor(weights, state.mean, steps)


def _residual(x: np.ndarray, model: Predictor) -> np.ndarray:
    known = len(model.weights)
    centred = x - model.mean
    return centred[:, known:] - centred[:, :known] @ model.weights


def predictor_score(model: Predictor, column: str | Column = "joint") -> Column:
    """Squared prediction error of the next vector."""
    return row_function(lambda x: np.square(_residual(x, model)).sum(axis=1), column)


def residual_vector(model: Predictor, column: str | Column = "joint") -> Column:
    from ..functions.vectors import matrix_function

    return matrix_function(lambda x: _residual(x, model), column)
