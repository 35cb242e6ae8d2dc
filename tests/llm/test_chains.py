"""The classifier chain on held-out rows."""

import random

import numpy as np
import pytest
from llm_help import documents

from trackscore.llm import chains

BAD = ["zogfoo", "zogbar", "zogbaz", "grump"]


def labelled(prose, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        toxic, poor = rng.random() < 0.2, rng.random() < 0.3
        words = prose(rng.randrange(5, 80)).split()
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD[:3]) + rng.choice("abcdef"))
        if poor:
            words += ["click", "here", "now"]
        rows.append((i, " ".join(words), int(poor), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def fitted(spark, prose):
    rows = labelled(prose, 600, 1)
    docs = documents(spark, [(i, t) for i, t, _, _ in rows])
    labels = spark.createDataFrame([(i, p, x, "other text") for i, _, p, x in rows] + [(None, 1, 1, ""), (99999, 1, 1, "")],
                                   "doc_id long, poor int, toxic int, text string")
    return docs, labels, chains.fit(chains.sample(labels, docs), ("poor", "toxic"))


def test_held_out_accuracy(spark, prose, fitted):
    rows = labelled(prose, 300, 2)
    got = {r.doc_id: r for r in chains.score(documents(spark, [(i, t) for i, t, _, _ in rows]), fitted[2]).collect()}
    assert np.mean([got[i].is_toxic == bool(x) for i, _, _, x in rows]) > 0.97
    assert np.mean([got[i].is_poor == bool(p) for i, _, p, _ in rows]) > 0.97


def test_later_models_use_earlier_probabilities(fitted):
    chain = fitted[2]
    assert [len(w) - len(f) for w, f in zip(chain.weights, chain.features)] == [1, 2]


def test_fit_is_repeatable_and_the_sample_is_bounded(fitted):
    docs, labels, chain = fitted
    again = chains.fit(chains.sample(labels, docs.repartition(5)), ("poor", "toxic"))
    assert all(np.allclose(a, b) for a, b in zip(chain.weights, again.weights)) and chain.features == again.features
    assert chains.sample(labels, docs, size=50).count() <= 50


def test_odd_rows_and_columns(spark, awkward, fitted):
    docs = documents(spark, awkward).selectExpr("*", "'x' AS p_toxic", "1 AS c0", "text AS _text")
    got = chains.score(docs, fitted[2]).collect()
    assert len(got) == len(awkward) and got[0].lang == "en" and isinstance(got[0].p_toxic, float)
    blank = {r.p_toxic for r in got if not (r.text or "").strip()}
    assert len(blank) == 1 and all(0 <= r.p_toxic <= 1 for r in got)
    assert chains.score(docs.where("false"), fitted[2]).collect() == []


def test_one_sided_labels_give_constant_models(spark, awkward):
    docs = documents(spark, awkward).selectExpr("*", "0 AS a", "CAST(NULL AS INT) AS b")
    for table in (docs, docs.where("false")):
        chain = chains.fit(table, ("a", "b"))
        assert not any(r.is_a or r.is_b for r in chains.score(docs, chain).collect())


def test_logistic_matches_its_gradient():
    rng = np.random.default_rng(1)
    x = np.hstack([np.ones((200, 1)), rng.normal(size=(200, 3))])
    y = (rng.random(200) < 1 / (1 + np.exp(-x @ [0.3, 1, -2, 0]))).astype(float)
    w = chains.logistic(x, y, ridge=0.5)
    p = 1 / (1 + np.exp(-x @ w))
    assert np.abs(x.T @ (p - y) + np.array([1e-6, 0.5, 0.5, 0.5]) * w).max() < 1e-5
