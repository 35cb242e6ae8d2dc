"""Toxicity by a classifier chain of linear models on hashed text features.

Categories are predicted one after another. The model of a category is a logistic
regression on the presence of words and word beginnings, plus the probabilities of all
earlier categories. In training those probabilities are out-of-fold: a text's earlier
probability comes from a model that has not seen it, so later models learn from the same
kind of input that they get when scoring.

The model is fitted on a sample of labelled rows of bounded size (``SAMPLE``, by hash of the
key, so the same rows are drawn at every run). Feature statistics of the sample are
aggregated by Spark; what reaches the driver are ``FEATURES`` rows per category and the
sample's few hits on them. Scoring reads whole texts in one pass without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import packed

SAMPLE = 20_000
FEATURES = 400
FOLDS = 3
PREFIXES = (4, 5)
MIN_TEXTS = 4
MIN_STRENGTH = 16.0  # chi-squared of a feature and the category
MEMO = 150_000  # words whose features a task remembers
RIDGE = 1.0
TRIM = b".,;:!?\"'()[]{}<>-"


@dataclass
class Chain:
    """Fitted models, in the order of prediction."""

    categories: list[str]
    features: list[dict[str, int]] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)  # intercept, earlier categories, features
    cut: list[float] = field(default_factory=list)


def word_features(word: bytes) -> list[str]:
    """A word and its beginnings; ``word`` may carry punctuation at its ends."""
    text = word.strip(TRIM).decode("utf-8", "replace").lower()
    return ["=" + text, *("^" + text[:n] for n in PREFIXES if len(text) > n)] if text else []


def _texts(batch: pa.RecordBatch, step: int = 512):
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        words = packed.Words(*packed.utf8_column(part.column("_text")), lower=True)
        yield part, words


def _presence(words: packed.Words, wanted) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature number) pairs; ``wanted`` maps a word to its feature numbers."""
    table = [wanted(w) for w in words.vocabulary.to_pylist()]
    sizes = np.fromiter(map(len, table), np.int64, len(table))
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hit = sizes[words.codes] > 0
    codes, docs = words.codes[hit], words.doc[hit]
    flat = np.concatenate([np.array(t, np.int64) for t in table if t])
    starts = np.cumsum(sizes) - sizes
    each = sizes[codes]
    at = np.repeat(starts[codes] - (np.cumsum(each) - each), each) + np.arange(each.sum())
    pairs = np.unique(np.repeat(docs, each) << 32 | flat[at])
    return pairs >> 32, pairs & 0xFFFFFFFF


def _count_features(categories: Sequence[str]):
    names = list(categories)

    def count(batches):
        total = Counter()
        positive = [Counter() for _ in names]
        for batch in batches:
            for part, words in _texts(batch):
                labels = [part.column(c).to_numpy(zero_copy_only=False) for c in names]
                known: dict[str, int] = {}

                def wanted(word, known=known):
                    return [known.setdefault(f, len(known)) for f in word_features(word)]

                docs, numbers = _presence(words, wanted)
                keys = list(known)
                for i, n in enumerate(np.bincount(numbers, minlength=len(keys))):
                    total[keys[i]] += int(n)
                for c, label in enumerate(labels):
                    own = np.bincount(numbers[label[docs] == 1], minlength=len(keys)) if len(keys) else []
                    for i in np.flatnonzero(own):
                        positive[c][keys[i]] += int(own[i])
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([total[k] for k in keys], pa.int64()),
             *(pa.array([p[k] for k in keys], pa.int64()) for p in positive)],
            names=["feature", "texts", *(f"in_{i}" for i in range(len(names)))])
        packed.release()

    return count


def _numbered(features: list[dict[str, int]]):
    """word -> numbers of its features, the categories' lists laid end to end."""
    at = np.cumsum([0, *map(len, features)])
    lists: dict[str, list[int]] = {}
    for c, own in enumerate(features):
        for f, n in own.items():
            lists.setdefault(f, []).append(int(at[c] + n))
    memo: dict[bytes, tuple[int, ...]] = {}

    def wanted(word: bytes) -> tuple[int, ...]:
        found = memo.get(word)
        if found is None:
            if len(memo) >= MEMO:
                memo.clear()
            found = memo[word] = tuple(n for f in word_features(word) for n in lists.get(f, ()))  # nearly all are ()
        return found

    return wanted


def _find_hits(features, categories):
    names = list(categories)

    def find(batches):
        wanted = _numbered(features)
        for batch in batches:
            for part, words in _texts(batch):
                docs, numbers = _presence(words, wanted)
                lists = [x.tolist() for x in np.split(numbers, np.searchsorted(docs, np.arange(1, part.num_rows)))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), *(part.column(c) for c in names), pa.array(lists, pa.list_(pa.int64()))],
                    names=["_id", *names, "hits"])

    return find


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first column is the intercept."""
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge)
    pull[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pull), x.T @ (p - y) + pull * w)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _probability(x, w):
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def _best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """Threshold with the best F1 on out-of-fold probabilities, midway to the next lower value."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    ends = np.append(p[order][1:] < p[order][:-1], True)  # equal values stand or fall together
    best = int(np.argmax(np.where(ends, f1, -1)))
    lower = p[order][best + 1] if best + 1 < len(p) else 0.0
    return float((p[order][best] + lower) / 2)


def fit(labelled: DataFrame, categories: Sequence[str], *, key: str = "doc_id", text: str = "text",
        features: int = FEATURES, folds: int = FOLDS) -> Chain:
    """Fit a chain on labelled texts; ``labelled`` must be of bounded size (see ``sample``).

    Labels are 0 or 1; a null label counts as 0. Null and empty texts have no features.
    Categories without both labels in the sample get a constant model.
    """
    packed.small_batches(labelled.sparkSession)
    names = [f"_label_{i}" for i in range(len(categories))]
    rows = labelled.select(
        F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"),
        *(F.coalesce(F.col(f"`{c}`").cast("int"), F.lit(0)).alias(n) for c, n in zip(categories, names)))
    counted = rows.mapInArrow(_count_features(names), "feature string, texts long, " + ", ".join(
        f"in_{i} long" for i in range(len(names)))).groupBy("feature").agg(
        F.sum("texts").alias("texts"), *(F.sum(f"in_{i}").alias(f"in_{i}") for i in range(len(names))))
    totals = rows.agg(F.count(F.lit(1)), *(F.sum(n) for n in names)).first()
    chosen: list[dict[str, int]] = []
    for i in range(len(names)):
        yes, all_texts = totals[i + 1] or 0, totals[0]
        a, n = F.col(f"in_{i}").cast("double"), F.col("texts").cast("double")
        apart = a * all_texts - n * yes
        strength = apart * apart / (n * (F.lit(all_texts) - n) * F.lit(max(1, yes)) * F.lit(max(1, all_texts - yes)))
        top = (counted.where((F.col("texts") >= MIN_TEXTS) & (F.col("texts") < all_texts))
               .withColumn("strength", strength * all_texts).where(F.col("strength") >= MIN_STRENGTH)
               .orderBy(F.desc("strength"), "feature").select("feature").limit(features)).collect()
        chosen.append({r[0]: n for n, r in enumerate(top)})
    found = (rows.mapInArrow(_find_hits(chosen, names), "_id long, " + ", ".join(f"{n} int" for n in names)
                             + ", hits array<long>").orderBy("_id", "hits").collect())
    at = np.cumsum([0, *map(len, chosen)])
    hits = np.zeros((len(found), at[-1]), np.uint8)
    for r, row in enumerate(found):
        hits[r, row["hits"]] = 1
    fold = np.array([hash_fold(row["_id"], folds) for row in found], int)
    labels = {n: np.array([row[n] for row in found], float) for n in names}
    del found
    chain, earlier = Chain(list(categories)), np.zeros((len(hits), 0))
    for i, name in enumerate(names):
        y = labels[name]
        x = np.hstack([np.ones((len(hits), 1)), earlier, hits[:, at[i]:at[i + 1]]])
        if len(y) and 0 < y.sum() < len(y):
            weights = logistic(x, y)
            apart = np.zeros(len(y))
            for f in range(folds):
                inside = fold != f
                own = y[inside]
                # Without both labels elsewhere there is no model to predict the fold with.
                apart[~inside] = (_probability(x[~inside], logistic(x[inside], own)) if 0 < own.sum() < len(own)
                                  else own.mean() if len(own) else y.mean())
            cut = _best_cut(apart, y)
        else:
            weights = np.zeros(x.shape[1])
            weights[0] = 20.0 if len(y) and y.all() else -20.0
            apart, cut = _probability(x, weights), 0.5
        chain.features.append(chosen[i])
        chain.weights.append(weights)
        chain.cut.append(cut)
        earlier = np.hstack([earlier, apart[:, None]])
    return chain


def hash_fold(key: int | None, folds: int) -> int:
    return ((key or 0) * 0x9E3779B97F4A7C15 % (1 << 64) >> 32) % folds


def sample(labels: DataFrame, docs: DataFrame, *, key: str = "doc_id", text: str = "text",
           size: int = SAMPLE) -> DataFrame:
    """At most ``size`` labelled rows with their texts, drawn by hash of the key.

    The sampled labels are the only side that is broadcast; ``size`` bounds them. Labels
    with a null key or without a document are left out.
    """
    drawn = (labels.where(F.col(f"`{key}`").isNotNull()).orderBy(F.xxhash64(f"`{key}`"), F.col(f"`{key}`")).limit(size))
    return materialize(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).join(F.broadcast(drawn.drop(text)), key))


def _scorer(chain: Chain):
    at = np.cumsum([0, *map(len, chain.features)])

    def score(batches):
        wanted = _numbered(chain.features)
        for batch in batches:
            columns = [[] for _ in chain.categories]
            for part, words in _texts(batch):
                docs, numbers = _presence(words, wanted)
                earlier = np.zeros((part.num_rows, 0))
                for c, w in enumerate(chain.weights):
                    inside = (numbers >= at[c]) & (numbers < at[c + 1])
                    own = np.bincount(docs[inside], w[1 + c + numbers[inside] - at[c]], minlength=part.num_rows)
                    total = w[0] + earlier @ w[1:1 + c] + own
                    p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
                    earlier = np.hstack([earlier, p[:, None]])
                    columns[c].append(p)
            kept = batch.drop_columns(["_text"]) if "_text" in batch.schema.names else batch
            found = [pa.array(np.concatenate(c) if c else np.zeros(0), pa.float64()) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept.columns, *found], names=[
                *kept.schema.names, *(f"p_{i}" for i in range(len(found)))])
        packed.release()

    return score


def score(docs: DataFrame, chain: Chain, *, text: str = "text") -> DataFrame:
    """``docs`` with ``p_<category>`` and ``is_<category>`` for every category of the chain.

    Columns of those names are replaced. Every row is kept; null, blank and empty texts
    have no features and get the base rates. An empty table gives an empty result.
    """
    new = {f"p_{c}" for c in chain.categories} | {f"is_{c}" for c in chain.categories}
    kept = [c for c in docs.columns if c not in new]
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)),
                        F.col(f"`{text}`").cast("string").alias("_text"))
    schema = ", ".join([*(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)),
                        *(f"p_{i} double" for i in range(len(chain.categories)))])
    packed.small_batches(docs.sparkSession)
    scored = inner.mapInArrow(_scorer(chain), schema)
    return scored.select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)),
        *(F.col(f"p_{i}").alias(f"p_{c}") for i, c in enumerate(chain.categories)),
        *((F.col(f"p_{i}") >= F.lit(chain.cut[i])).alias(f"is_{c}") for i, c in enumerate(chain.categories)))
