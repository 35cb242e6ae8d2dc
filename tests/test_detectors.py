"""Fitted states and scores against NumPy; gradients against finite differences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackscore.models import kernels, training
from trackscore.operators import detectors as od
from trackscore.operators import transitions as ot
from trackscore.operators.tracks import tracks

WIDTH = 5


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    x = (rng.standard_normal((300, WIDTH)) @ rng.standard_normal((WIDTH, WIDTH)) + 3).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, feature array<float>")
    return df.repartition(5).persist(), x.astype(np.float64)


def scores(df, column):
    return np.array([r.s for r in df.select("id", column.alias("s")).orderBy("id").collect()])


def test_gaussian_state(vectors):
    df, x = vectors
    state = od.fit_gaussian(df, WIDTH)
    c = x - x.mean(0)
    np.testing.assert_allclose(state.mean, x.mean(0), rtol=1e-9)
    np.testing.assert_allclose(state.covariance, c.T @ c / len(x), rtol=1e-8)
    np.testing.assert_allclose(state.fourth, np.square(np.square(c).sum(1)).mean(), rtol=1e-7)
    assert state.n == 300
    with pytest.raises(ValueError, match="no rows"):
        od.fit_gaussian(df.where("id < 0"), WIDTH)


def test_absent_vectors_do_not_spoil_a_fit(vectors, spark):
    df, x = vectors
    more = df.unionByName(spark.createDataFrame([(1000, None), (1001, None)], df.schema))
    state = od.fit_gaussian(more, WIDTH)
    np.testing.assert_allclose(state.mean, x.mean(0), rtol=1e-9)
    assert state.n == 300 and np.isfinite(state.covariance).all()


def test_distances(vectors):
    df, x = vectors
    state = od.fit_gaussian(df, WIDTH)
    c = x - x.mean(0)
    np.testing.assert_allclose(scores(df, od.euclidean_score(od.fit_mean(df))), np.square(c).sum(1), rtol=1e-6)
    mean, variance = od.fit_diagonal(df)
    np.testing.assert_allclose(scores(df, od.diagonal_score(mean, variance)), (c**2 / x.var(0)).sum(1), rtol=1e-5)
    full = np.einsum("ij,jk,ik->i", c, np.linalg.inv(np.cov(x.T, bias=True)), c)
    np.testing.assert_allclose(scores(df, od.mahalanobis_score(state.mean, state.covariance)), full, rtol=1e-5)


def test_shrinkage_is_ledoit_wolf(vectors):
    df, x = vectors
    state = od.fit_gaussian(df, WIDTH)
    c = x - x.mean(0)
    s = c.T @ c / len(x)
    target = np.trace(s) / WIDTH * np.eye(WIDTH)
    noise = np.mean([np.square(np.outer(v, v) - s).sum() for v in c]) / len(x)
    weight = min(noise, np.square(s - target).sum()) / np.square(s - target).sum()
    got, used = od.shrunk(state)
    np.testing.assert_allclose(used, weight, rtol=1e-6)
    np.testing.assert_allclose(got, (1 - weight) * s + weight * target, rtol=1e-6)
    assert {r.variant for r in od.condition_numbers(df.sparkSession, state).collect()} == {
        "diagonal", "full", "ridge", "shrunk"}


def test_pca_reconstruction(vectors):
    df, x = vectors
    pca = od.principal_components(od.fit_gaussian(df, WIDTH), 2)
    _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    c = x - x.mean(0)
    want = np.square(c - c @ axes[:2].T @ axes[:2]).sum(1)
    np.testing.assert_allclose(scores(df, od.linear_autoencoder_score(pca)), want, rtol=1e-4, atol=1e-6)
    np.testing.assert_allclose(
        scores(df, od.pca_euclidean_score(pca)), np.square(c @ axes[:2].T).sum(1), rtol=1e-4)


def test_isolation_forest_ranks_an_outlier_first(spark, vectors):
    df, x = vectors
    far = spark.createDataFrame([(999, [50.0] * WIDTH)], df.schema)
    nodes = od.grow_forest(df, "id", WIDTH, n_trees=30, copies=6)
    assert nodes.select("tree").distinct().count() == 30
    everything = df.unionByName(far)
    top = everything.select("id", od.forest_score(nodes).alias("s")).orderBy(F.desc("s")).first()
    assert top.id == 999 and 0.5 < top.s <= 1
    again = od.grow_forest(df.repartition(2), "id", WIDTH, n_trees=30, copies=6)
    assert nodes.where("node = 0").agg(F.sum("size")).first()[0] == 6 * 300  # no row is left out
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, nodes.collect()))


def test_predictor_learns_linear_dynamics(spark):
    rng = np.random.default_rng(1)
    step = np.array([[0.8, 0.3], [-0.3, 0.8]])
    z, rows = rng.standard_normal(2), []
    for t in range(200):
        rows.append(("v", 0, t * 1.0, t, z.astype(np.float32).tolist()))
        z = z @ step + 0.01 * rng.standard_normal(2)
    df = spark.createDataFrame(rows, "video_id string, target_id int, timestamp double, row_ord long, feature array<float>")
    history = od.with_history(tracks(df), 2)
    assert history.count() == 198 and len(history.first().joint) == 6
    model = od.fit_predictor(history, 2, 2, strength=1e-6)
    error = history.select(F.avg(od.predictor_score(model)).alias("e")).first().e
    spread = history.select(F.avg(F.pow(F.col("feature")[0], 2) + F.pow(F.col("feature")[1], 2)).alias("e")).first().e
    assert error < 0.2 * spread
    size = history.select(od.residual_vector(model).alias("r")).first().r
    assert len(size) == 2


def test_transitions(spark):
    rows = [("v", 0, float(t), t, s) for t, s in enumerate([0, 1, 0, 1, 1, 2])]
    df = spark.createDataFrame(rows, "video_id string, target_id int, timestamp double, row_ord long, action_id int")
    pairs = ot.with_previous(tracks(df))
    model = ot.fit_transitions(pairs)
    assert {(r.prev_state, r.state): round(r.probability, 3) for r in model.collect()} == {
        (0, 1): 1.0, (1, 0): 0.333, (1, 1): 0.333, (1, 2): 0.333}
    new = spark.createDataFrame([(2, 0), (9, 0), (0, 1)], "prev_state int, state int")
    assert [tuple(r) for r in ot.unseen_transitions(new, pairs).select("prev_state", "state").collect()] == [(2, 0)]
    assert ot.score_transitions(new, model).where("prev_state = 9").first().score > 13


@pytest.mark.parametrize("kernel,shape", [
    (kernels.FlatVAE(4, 6, 3), (5, 4)), (kernels.SequenceVAE(4, 5, 3), (3, 6, 4))])
def test_gradients(kernel, shape):
    rng = np.random.default_rng(2)
    weights = kernels.initial_weights(kernel) + 0.1 * rng.standard_normal(kernels.n_parameters(kernel))
    x, eps = rng.random(shape), rng.standard_normal((shape[0], kernel.latent_dim))

    def loss(w):
        return sum(kernel.step(kernels.unpack(kernel, w), x, eps)[:2])

    grad = kernels.pack(kernel, kernel.step(kernels.unpack(kernel, weights), x, eps)[2])
    for i in rng.choice(len(weights), 60, replace=False):
        bump = np.zeros(len(weights))
        bump[i] = 1e-6
        np.testing.assert_allclose(
            grad[i], (loss(weights + bump) - loss(weights - bump)) / 2e-6, rtol=1e-4, atol=1e-5)


def test_parameter_counts():
    assert kernels.n_parameters(kernels.FlatVAE(256)) == 111_424
    assert kernels.n_parameters(kernels.SequenceVAE(256)) == 321_856


def test_training_lowers_loss_and_repeats(spark):
    rng = np.random.default_rng(4)
    base = rng.random((2, 6))
    rows = [(i, (base[i % 2] * 0.8 + 0.1).tolist(), "val" if i % 5 == 0 else "train") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, feature array<double>, fold string")
    options = dict(hidden_dim=8, latent_dim=2, epochs=15, lr=1e-2, partitions=2)
    kernel, weights, losses = training.fit_vae(df, "id", 6, **options)
    history = training.history_frame(training.reduce_losses(losses)).orderBy("epoch").collect()
    assert [r.epoch for r in history] == list(range(1, 16))
    assert history[-1].train_loss < 0.7 * history[0].train_loss
    for r in history:
        assert abs(r.train_loss - r.train_recon - r.train_kl) < 1e-6
    _, again, _ = training.fit_vae(df.repartition(7), "id", 6, **options)
    np.testing.assert_array_equal(weights, again)
    scored = training.score_model(df, kernel, weights).orderBy("id").first()
    x = np.array([scored.feature])
    recon, mu, logvar = kernel.forward(kernels.unpack(kernel, weights), x)
    np.testing.assert_allclose(scored.score, np.square(recon - x).sum(), rtol=1e-9)
    np.testing.assert_allclose(scored.mu, mu[0])


def test_loss_divisors(spark):
    rows = [("m", 1, "train", 60.0, 40.0, 20.0, 2, 10, 100), ("m", 1, "val", 30.0, 20.0, 10.0, 1, 5, 50)]
    losses = spark.createDataFrame(rows, training.LOSS_SCHEMA)
    got = {d: training.reduce_losses(losses, d).where("split = 'train'").first().loss
           for d in ("batches", "dataset", "rows", "elements")}
    assert got == {"batches": 30.0, "dataset": 4.0, "rows": 6.0, "elements": 0.6}
