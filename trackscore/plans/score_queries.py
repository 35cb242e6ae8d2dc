"""Queries: detectors over feature vectors and the metrics of their scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.spectral import RANK_TOLERANCE, SWEEPS
from ..operators import detectors as od
from ..operators import metrics as om
from ..operators import splits, tracks
from ..operators import transitions as ot
from ..session import materialize
from ..sources import driver_tables as dt
from ..sources.driver_tables import ANNOTATIONS_SQL
from .box_queries import VIDEO_SPLIT, split_sql
from .registry import query
from .track_queries import featured, normal_rows, video_split

DIM = 64
MODELS = ("euclidean", "mahalanobis")

VEC_SPLIT = split_sql("embeddings", "vec_id", [("test", 40), ("val", 60)])
SCORES_VIEWS = f"""{VEC_SPLIT},
el AS (SELECT vec_id, label, fold, unnest(generate_series(0, {DIM - 1}))::INT AS dim, unnest(embedding)::DOUBLE AS x
  FROM embeddings JOIN split USING (vec_id)),
st AS (SELECT dim, avg(x) AS mean, var_pop(x) AS variance FROM el WHERE fold = 'train' AND label <= 2 GROUP BY dim),
scores AS (
  SELECT 'euclidean' AS model, vec_id, any_value(label) AS label, any_value(fold) AS fold, any_value(label) > 2 AS positive,
    round(sum((x - mean) * (x - mean)), 6) AS score FROM el JOIN st USING (dim) GROUP BY vec_id
  UNION ALL
  SELECT 'mahalanobis', vec_id, any_value(label), any_value(fold), any_value(label) > 2,
    round(sum((x - mean) * (x - mean) / (variance + 1e-8::DOUBLE)), 6) FROM el JOIN st USING (dim) GROUP BY vec_id)"""


def labelled(spark, sf):
    """Vectors with a fold and the truth: labels above 2 are novel."""
    rows = dt.features(spark, sf)
    split = splits.grouped_split(rows, "vec_id", {"test": 40, "val": 20})
    return splits.assign_split(rows, split, "vec_id").withColumn(
        "positive", F.col("label") > dt.NORMAL_LABEL_MAX)


def fit_rows(rows):
    return rows.where((F.col("fold") == "train") & ~F.col("positive"))


def scored(spark, sf):
    """Both distance models over all vectors, one row per (model, vector)."""
    rows = labelled(spark, sf)
    mean, variance = od.fit_diagonal(fit_rows(rows))
    both = rows.select(
        "vec_id", "label", "fold", "positive",
        F.round(od.euclidean_score(mean), 6).alias("euclidean"),
        F.round(od.diagonal_score(mean, variance), 6).alias("mahalanobis"))
    return both.select(
        "vec_id", "label", "fold", "positive",
        F.explode(F.array(*[
            F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in MODELS])).alias("s"),
    ).select("vec_id", "label", "fold", "positive", "s.model", "s.score")


@query("euclidean", "SELECT vec_id, score FROM scores WHERE model = 'euclidean'", SCORES_VIEWS)
def euclidean(spark, sf):
    rows = labelled(spark, sf)
    mean = od.fit_mean(fit_rows(rows))
    return rows.select("vec_id", F.round(od.euclidean_score(mean), 6).alias("score"))


@query("mahalanobis_diag", "SELECT vec_id, score FROM scores WHERE model = 'mahalanobis'", SCORES_VIEWS)
def mahalanobis_diag(spark, sf):
    rows = labelled(spark, sf)
    mean, variance = od.fit_diagonal(fit_rows(rows))
    return rows.select("vec_id", F.round(od.diagonal_score(mean, variance), 6).alias("score"))


@query("covariance", """,
c AS (SELECT vec_id, dim, x - mean AS d FROM el JOIN st USING (dim) WHERE fold = 'train' AND label <= 2)
SELECT a.dim AS i, b.dim AS j, round(sum(a.d * b.d) / count(*), 8) AS cov
FROM c a JOIN c b USING (vec_id) GROUP BY ALL
""", SCORES_VIEWS)
def covariance(spark, sf):
    table = od.covariance_table(spark, od.fit_gaussian(fit_rows(labelled(spark, sf)), DIM))
    return table.withColumn("cov", F.round("cov", 8))


def _score_all(spark, sf, column_of):
    rows = labelled(spark, sf)
    state = od.fit_gaussian(fit_rows(rows), DIM)
    return rows.select("vec_id", F.round(column_of(state), 6).alias("score"))


def eliminate_sql(matrix: str, width: int, out: str) -> str:
    """Gauss-Jordan elimination in SQL: ``matrix`` (m: rows of a positive definite matrix, each followed
    by right sides) becomes ``out`` (m: the identity followed by the solutions), one step per pivot."""
    return f"""{out}_steps(k, m) AS (SELECT 1::BIGINT, m FROM {matrix} UNION ALL
  SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(p, lambda x: x / p[k])
    ELSE list_transform(list_zip(r, p), lambda z: z[1] - r[k] / p[k] * z[2]) END)
  FROM (SELECT k, m, m[k] AS p FROM {out}_steps WHERE k <= {width})),
{out} AS (SELECT m FROM {out}_steps WHERE k = {width} + 1)"""


def jacobi_sql(matrix: str, width: int, out: str) -> str:
    """Jacobi rounds in SQL: ``matrix`` (m: rows of a symmetric matrix of even width) becomes ``out``
    (k: place by falling eigenvalue, from 1; value; vec). ``o`` are the opponents of a round, ``c`` and
    ``d`` the shares of its own and its opponent's row that a row turns into."""
    return f"""{out}_rounds(n, a, v) AS (
  SELECT 0::BIGINT, m, list_transform(range({width}), lambda i: list_transform(range({width}), lambda j:
    CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) FROM {matrix}
  UNION ALL
  SELECT n + 1, list_transform(w, lambda r: list_transform(list_zip(r, list_select(r, o), c, d), lambda z: z[3] * z[1] + z[4] * z[2])),
    list_transform(list_zip(v, list_select(v, o), c, d), lambda z: list_transform(list_zip(z[1], z[2]), lambda y: z[3] * y[1] + z[4] * y[2]))
  FROM (SELECT *, list_transform(list_zip(a, list_select(a, o), c, d), lambda z:
      list_transform(list_zip(z[1], z[2]), lambda y: z[3] * y[1] + z[4] * y[2])) AS w
    FROM (SELECT *, list_transform(t, lambda x: 1 / sqrt(1 + x * x)) AS c,
        list_transform(t, lambda x, i: CASE WHEN i < o[i] THEN -x ELSE x END / sqrt(1 + x * x)) AS d
      FROM (SELECT *, list_transform(x, lambda z: CASE WHEN z.f = 0 THEN 0.0::DOUBLE ELSE
            CASE WHEN (z.h - z.l) / (2 * z.f) < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END
            / (abs((z.h - z.l) / (2 * z.f)) + sqrt(1 + (z.h - z.l) / (2 * z.f) * ((z.h - z.l) / (2 * z.f)))) END) AS t
        FROM (SELECT *, list_transform(o, lambda j, i: {{'f': a[least(i, j)][greatest(i, j)], 'l': a[least(i, j)][least(i, j)],
              'h': a[greatest(i, j)][greatest(i, j)]}}) AS x
          FROM (SELECT *, list_transform(range({width}), lambda i: CASE
                WHEN i = {width - 1} THEN n % {width - 1} WHEN (2 * (n % {width - 1}) - i + {width - 1}) % {width - 1} = i THEN {width - 1}
                ELSE (2 * (n % {width - 1}) - i + {width - 1}) % {width - 1} END + 1) AS o
            FROM {out}_rounds WHERE n < {SWEEPS * (width - 1)})))))),
{out} AS (SELECT row_number() OVER (ORDER BY value DESC) AS k, value, vec FROM (
  SELECT a[i][i] AS value, v[i] AS vec FROM {out}_rounds, range(1, {width + 1}) t(i) WHERE n = {SWEEPS * (width - 1)}))"""


# Deviations, covariance and its sums under the statistics of the training rows.
DEVIATIONS_SQL = f"""
dv AS (SELECT vec_id, dim, x - mean AS d, fold = 'train' AND label <= 2 AS fits FROM el JOIN st USING (dim)),
cv AS (SELECT a.dim AS i, b.dim AS j, sum(a.d * b.d) / count(*) AS v
  FROM dv a JOIN dv b USING (vec_id) WHERE a.fits AND b.fits GROUP BY ALL),
sq AS (SELECT vec_id, sum(d * d) AS q FROM dv WHERE fits GROUP BY vec_id),
su AS (SELECT sum(v) FILTER (i = j) AS tr, sum(v * v) AS ss, (SELECT avg(q * q) FROM sq) AS fourth,
  (SELECT count(*) FROM sq) AS n, {DIM} AS w FROM cv)"""


def spectrum_sql(covariance: str, name: str) -> str:
    """Eigenvalues and vectors of ``covariance``, an entry's SQL over ``cv`` and ``su``, as the view ``name``."""
    return f"""{name}_m AS (SELECT list(r ORDER BY i) AS m FROM (
  SELECT i, list({covariance} ORDER BY j) AS r FROM cv, su GROUP BY i)),
{jacobi_sql(f"{name}_m", DIM, name)}"""


def mahalanobis_sql(covariance: str) -> str:
    """Distances under ``covariance``: SQL over ``cv`` (i, j, v) and ``su`` (its sums) for an entry."""
    return f"""WITH RECURSIVE {SCORES_VIEWS},{DEVIATIONS_SQL},
m0 AS (SELECT list(r ORDER BY i) AS m FROM (
  SELECT i, list_concat(list({covariance} ORDER BY j), list_transform(range({DIM}), lambda k: CASE WHEN k = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS r
  FROM cv, su GROUP BY i)),
{eliminate_sql("m0", DIM, "inv")},
pr AS (SELECT unnest(range({DIM})) AS i, unnest(m) AS r FROM inv),
pe AS (SELECT i, unnest(range({DIM})) AS j, unnest(r[{DIM} + 1:]) AS v FROM pr),
y AS (SELECT vec_id, i, sum(v * d) AS y FROM pe JOIN dv ON dv.dim = pe.j GROUP BY ALL)
SELECT dv.vec_id, round(sum(dv.d * y), 6) AS score FROM y JOIN dv ON dv.vec_id = y.vec_id AND dv.dim = y.i GROUP BY dv.vec_id
"""


#: y: the square of each vector's part along each eigenvector.
PARTS_SQL = f""",
ev AS (SELECT k, value, unnest(range({DIM})) AS dim, unnest(vec) AS e FROM full_),
y AS (SELECT vec_id, k, any_value(value) AS value, pow(sum(d * e), 2) AS y FROM dv JOIN ev USING (dim) GROUP BY ALL)"""


@query("mahalanobis_full", f"""WITH RECURSIVE {SCORES_VIEWS},{DEVIATIONS_SQL},
{spectrum_sql("v", "full_")}{PARTS_SQL}
SELECT vec_id, round(sum(y / value), 4) AS score FROM y
WHERE value > {RANK_TOLERANCE}::DOUBLE * (SELECT max(value) FROM full_) GROUP BY vec_id
""", views=None)
def mahalanobis_full(spark, sf):
    """Few training rows give a singular covariance: directions without variance are left out."""
    rows = labelled(spark, sf)
    state = od.fit_gaussian(fit_rows(rows), DIM)
    return rows.select("vec_id", F.round(od.mahalanobis_score(state.mean, state.covariance), 4).alias("score"))


RIDGE_SQL = "v + CASE WHEN i = j THEN 0.001::DOUBLE * tr / w ELSE 0 END"


@query("mahalanobis_ridge", mahalanobis_sql(RIDGE_SQL), views=None)
def mahalanobis_ridge(spark, sf):
    return _score_all(spark, sf, lambda s: od.mahalanobis_score(s.mean, od.ridge(s)))


# The shrinkage weight: noise of the entries over the spread around a scaled identity.
WEIGHT_SQL = "least(1, greatest(0, (fourth - ss) / n / (ss - tr * tr / w)))"
SHRUNK_SQL = f"(1 - {WEIGHT_SQL}) * v + CASE WHEN i = j THEN {WEIGHT_SQL} * tr / w ELSE 0 END"


@query("mahalanobis_shrunk", mahalanobis_sql(SHRUNK_SQL), views=None)
def mahalanobis_shrunk(spark, sf):
    return _score_all(spark, sf, lambda s: od.mahalanobis_score(s.mean, od.shrunk(s)[0]))


VARIANTS = {
    "diagonal": "CASE WHEN i = j THEN v ELSE 0 END",
    "full": "v",
    "ridge": RIDGE_SQL,
    "shrunk": SHRUNK_SQL,
}


@query("condition_numbers", f"""WITH RECURSIVE {SCORES_VIEWS},{DEVIATIONS_SQL},
""" + ",\n".join(spectrum_sql(c, f"{name}_") for name, c in VARIANTS.items()) + f""",
every AS ({" UNION ALL ".join(f"SELECT '{name}' AS variant, value FROM {name}_" for name in VARIANTS)}),
top AS (SELECT variant, max(value) AS top FROM every GROUP BY variant),
kept AS (SELECT variant, CAST(count(*) AS INTEGER) AS rank, round(max(value) / min(value), 4) AS kept_condition
  FROM every JOIN top USING (variant) WHERE value > {RANK_TOLERANCE}::DOUBLE * top GROUP BY variant)
SELECT variant, rank, CASE WHEN rank = {DIM} THEN kept_condition END AS condition, kept_condition FROM kept
""", views=None)
def condition_numbers(spark, sf):
    ledger = od.condition_numbers(spark, od.fit_gaussian(fit_rows(labelled(spark, sf)), DIM))
    return ledger.withColumns({c: F.round(c, 4) for c in ("condition", "kept_condition")})


COMPONENTS = 16


@query("pca_scores", f"""WITH RECURSIVE {SCORES_VIEWS},{DEVIATIONS_SQL},
{spectrum_sql("v", "full_")}{PARTS_SQL},
p AS (SELECT vec_id, sum(y) AS e, sum(y / (value + 1e-8::DOUBLE)) AS m FROM y WHERE k <= {COMPONENTS} GROUP BY vec_id),
n AS (SELECT vec_id, sum(d * d) AS whole FROM dv GROUP BY vec_id)
SELECT vec_id, round(e, 6) AS euclidean, round(m, 6) AS mahalanobis, round(whole - e, 6) AS reconstruction FROM p JOIN n USING (vec_id)
""", views=None)
def pca_scores(spark, sf):
    """No score depends on the sign of a component."""
    rows = labelled(spark, sf)
    pca = od.principal_components(od.fit_gaussian(fit_rows(rows), DIM), COMPONENTS)
    return rows.select(
        "vec_id",
        F.round(od.pca_euclidean_score(pca), 6).alias("euclidean"),
        F.round(od.pca_mahalanobis_score(pca), 6).alias("mahalanobis"),
        F.round(od.linear_autoencoder_score(pca), 6).alias("reconstruction"))


def drawn_sql(*parts: str) -> str:
    text = " || ':' || ".join(parts)
    return f"CAST('0x' || substr(sha256({text}), 1, 15) AS BIGINT)"


EXPECTED_SQL = f"CASE WHEN n > 2 THEN 2 * (ln(n - 1) + {float(np.euler_gamma)!r}::DOUBLE) - 2 * (n - 1)::DOUBLE / n WHEN n = 2 THEN 1 ELSE 0 END"
FOREST_SQL = f"""WITH RECURSIVE {SCORES_VIEWS},
own AS (SELECT vec_id, embedding AS e, unnest(range({od.COPIES})) AS k FROM embeddings JOIN split USING (vec_id)
  WHERE fold = 'train' AND label <= 2),
g AS (SELECT 0 AS level, CAST(({drawn_sql("'42'", "vec_id")} + k * {od.TREES // od.COPIES}) % {od.TREES} AS INT) AS tree, 0 AS node, vec_id, e
  FROM own UNION ALL
  SELECT level + 1, tree, 2 * node + 1 + CASE WHEN v > lo + {drawn_sql("'42'", "tree", "node", "'cut'")} / (16.0::DOUBLE ** 15) * (hi - lo)
    THEN 1 ELSE 0 END, vec_id, e
  FROM (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi, count(*) OVER w AS n FROM (
    SELECT *, e[1 + {drawn_sql("'42'", "tree", "node", "'dim'")} % {DIM}]::DOUBLE AS v FROM g)
    WINDOW w AS (PARTITION BY tree, node)) WHERE level < {od.LEVELS} AND n > 1 AND lo < hi),
nd AS (SELECT tree, node, {drawn_sql("'42'", "tree", "node", "'dim'")} % {DIM} AS dim, any_value(level) AS level, count(*) AS n,
  min(e[1 + {drawn_sql("'42'", "tree", "node", "'dim'")} % {DIM}]::DOUBLE) AS lo, max(e[1 + {drawn_sql("'42'", "tree", "node", "'dim'")} % {DIM}]::DOUBLE) AS hi
  FROM g GROUP BY tree, node),
nodes AS (SELECT tree, node, dim, n, level < {od.LEVELS} AND n > 1 AND lo < hi AS inner_,
  lo + {drawn_sql("'42'", "tree", "node", "'cut'")} / (16.0::DOUBLE ** 15) * (hi - lo) AS cut FROM nd),
walk AS (SELECT vec_id, embedding AS e, tree, 0 AS node, 0 AS depth FROM embeddings, (SELECT DISTINCT tree FROM nodes) t UNION ALL
  SELECT vec_id, e, tree, 2 * node + 1 + CASE WHEN e[1 + dim]::DOUBLE > cut THEN 1 ELSE 0 END, depth + 1
  FROM walk JOIN nodes USING (tree, node) WHERE inner_),
ends AS (SELECT vec_id, depth + {EXPECTED_SQL} AS path FROM walk JOIN nodes USING (tree, node) WHERE NOT inner_),
usual AS (SELECT {EXPECTED_SQL} AS c FROM (SELECT max(n) AS n FROM nodes WHERE node = 0))
SELECT vec_id, round(2.0::DOUBLE ** (-sum(path) / count(*) / max(c)), 6) AS score FROM ends, usual GROUP BY vec_id
"""


@query("isolation_forest", FOREST_SQL, views=None)
def isolation_forest(spark, sf):
    rows = labelled(spark, sf)
    nodes = od.grow_forest(fit_rows(rows), "vec_id", DIM)
    return rows.select("vec_id", F.round(od.forest_score(nodes), 6).alias("score"))


LAGS = 3
KNOWN = LAGS * DIM
LAGGED_SQL = f"""WITH RECURSIVE {ANNOTATIONS_SQL}, {VIDEO_SPLIT},
tk AS (SELECT a.row_ord, s.fold, e.embedding AS f, a.video_id, a.target_id, a.timestamp
  FROM annotations a JOIN split s USING (video_id) JOIN embeddings e USING (vec_id) WHERE action_id IN (0,1,2)),
lg AS (SELECT row_ord, fold, row_number() OVER w AS pos, list_concat(list_concat(lag(f, 3) OVER w, lag(f, 2) OVER w),
  list_concat(lag(f, 1) OVER w, f)) AS joint FROM tk WINDOW w AS (PARTITION BY video_id, target_id ORDER BY timestamp, row_ord)),
el AS (SELECT row_ord, fold, unnest(range({KNOWN + DIM})) AS dim, unnest(joint)::DOUBLE AS x FROM lg WHERE pos > {LAGS}),
mu AS (SELECT dim, avg(x) AS mean FROM el WHERE fold = 'train' GROUP BY dim),
dv AS (SELECT row_ord, fold, dim, x - mean AS d FROM el JOIN mu USING (dim)),
cv AS (SELECT a.dim AS i, b.dim AS j, sum(a.d * b.d) / count(*) AS v
  FROM dv a JOIN dv b USING (row_ord) WHERE a.fold = 'train' AND a.dim < {KNOWN} GROUP BY ALL),
pn AS (SELECT 0.01::DOUBLE * sum(v) / {KNOWN} AS p FROM cv WHERE i = j),
m0 AS (SELECT list(r ORDER BY i) AS m FROM (
  SELECT i, list(v + CASE WHEN i = j THEN p ELSE 0 END ORDER BY j) AS r FROM cv, pn GROUP BY i)),
{eliminate_sql("m0", KNOWN, "sol")},
wr AS (SELECT unnest(range({KNOWN})) AS i, unnest(m) AS r FROM sol),
wt AS (SELECT i, unnest(range({DIM})) + {KNOWN} AS dim, unnest(r[{KNOWN + 1}:]) AS v FROM wr),
said AS (SELECT row_ord, wt.dim, sum(wt.v * dv.d) AS d FROM wt JOIN dv ON dv.dim = wt.i GROUP BY ALL),
rs AS (SELECT row_ord, o.fold, dim - {KNOWN} AS dim, o.d - said.d AS x FROM said JOIN dv o USING (row_ord, dim))"""
RESIDUAL_SQL = f"""{LAGGED_SQL},
rm AS (SELECT dim, avg(x) AS mean FROM rs WHERE fold = 'train' GROUP BY dim),
rd AS (SELECT row_ord, fold, dim, x - mean AS d FROM rs JOIN rm USING (dim)),
rc AS (SELECT a.dim AS i, b.dim AS j, sum(a.d * b.d) / count(*) AS v
  FROM rd a JOIN rd b USING (row_ord) WHERE a.fold = 'train' GROUP BY ALL),
rt AS (SELECT 0.001::DOUBLE * sum(v) / {DIM} AS p FROM rc WHERE i = j),
n0 AS (SELECT list(r ORDER BY i) AS m FROM (
  SELECT i, list_concat(list(v + CASE WHEN i = j THEN p ELSE 0 END ORDER BY j),
    list_transform(range({DIM}), lambda k: CASE WHEN k = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS r FROM rc, rt GROUP BY i)),
{eliminate_sql("n0", DIM, "rinv")},
rr AS (SELECT unnest(range({DIM})) AS i, unnest(m) AS r FROM rinv),
re AS (SELECT i, unnest(range({DIM})) AS j, unnest(r[{DIM} + 1:]) AS v FROM rr),
ry AS (SELECT row_ord, i, sum(v * d) AS y FROM re JOIN rd ON rd.dim = re.j GROUP BY ALL)
SELECT rd.row_ord, round(sum(rd.d * y), 6) AS score FROM ry JOIN rd ON rd.row_ord = ry.row_ord AND rd.dim = ry.i GROUP BY rd.row_ord
"""


def histories(spark, sf, steps=3):
    rows = featured(spark, sf, normal_rows(spark, sf)).select(
        "video_id", "target_id", "timestamp", "row_ord", "feature")
    rows = splits.split_windows(rows, video_split(spark, sf))
    # Read by every fit and by the score, so it is computed once.
    return materialize(od.with_history(tracks.tracks(rows), steps).select("row_ord", "fold", "joint"))


@query("lagged_ridge", LAGGED_SQL + " SELECT row_ord, round(sum(x * x), 6) AS score FROM rs GROUP BY row_ord", views=None)
def lagged_ridge(spark, sf):
    rows = histories(spark, sf)
    model = od.fit_predictor(rows.where(F.col("fold") == "train"), 3, DIM)
    return rows.select("row_ord", F.round(od.predictor_score(model), 6).alias("score"))


@query("residual_mahalanobis", RESIDUAL_SQL, views=None)
def residual_mahalanobis(spark, sf):
    rows = histories(spark, sf)
    train = rows.where(F.col("fold") == "train")
    model = od.fit_predictor(train, 3, DIM)
    state = od.fit_gaussian(train.select(od.residual_vector(model).alias("residual")), DIM, "residual")
    return rows.select("row_ord", od.residual_vector(model).alias("residual")).select(
        "row_ord",
        F.round(od.mahalanobis_score(state.mean, od.ridge(state), "residual"), 6).alias("score"))


PAIRS_SQL = """,
p AS (SELECT video_id, row_ord, action_id AS state,
  lag(action_id) OVER (PARTITION BY video_id, target_id ORDER BY timestamp, row_ord) AS prev_state FROM annotations),
pairs AS (SELECT * FROM p WHERE prev_state IS NOT NULL)"""


def pairs(spark, sf):
    rows = dt.annotations(spark, sf).select(
        "video_id", "target_id", "timestamp", "row_ord", "action_id")
    return ot.with_previous(tracks.tracks(rows)).select("video_id", "row_ord", "prev_state", "state")


@query("markov_model", PAIRS_SQL + """
SELECT prev_state, state, count(*) AS n,
  round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY prev_state)::DOUBLE, 6) AS probability FROM pairs GROUP BY prev_state, state
""")
def markov_model(spark, sf):
    return ot.fit_transitions(pairs(spark, sf)).withColumn("probability", F.round("probability", 6))


@query("markov_transitions", PAIRS_SQL + f""", {split_sql('annotations', 'video_id', [('val', 20)])},
tr AS (SELECT * FROM pairs JOIN split USING (video_id) WHERE fold = 'train'),
m AS (SELECT prev_state, state, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY prev_state)::DOUBLE AS probability
  FROM tr GROUP BY prev_state, state)
SELECT row_ord, round(-ln(coalesce(probability, 1e-6::DOUBLE)), 6) AS score
FROM pairs LEFT JOIN m USING (prev_state, state)
""")
def markov_transitions(spark, sf):
    rows = pairs(spark, sf)
    split = splits.grouped_split(dt.annotations(spark, sf), "video_id")
    train = splits.split_windows(rows, split).where(F.col("fold") == "train")
    return ot.score_transitions(rows, ot.fit_transitions(train)).select(
        "row_ord", F.round("score", 6).alias("score"))


FINE_PAIRS_SQL = """,
f AS (SELECT video_id, row_ord, CAST(action_id * 20 + floor(x1 * 10) AS INT) AS state,
  lag(CAST(action_id * 20 + floor(x1 * 10) AS INT)) OVER (PARTITION BY video_id, target_id ORDER BY timestamp, row_ord) AS prev_state
  FROM annotations),
pairs AS (SELECT * FROM f WHERE prev_state IS NOT NULL)"""


@query("unseen_transitions", FINE_PAIRS_SQL + f""", {split_sql('annotations', 'video_id', [('val', 20)])},
tr AS (SELECT * FROM pairs JOIN split USING (video_id) WHERE fold = 'train'),
known AS (SELECT state AS s FROM tr UNION SELECT prev_state FROM tr)
SELECT row_ord, prev_state, state FROM pairs p
WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.prev_state = p.prev_state AND tr.state = p.state)
  AND state IN (SELECT s FROM known) AND prev_state IN (SELECT s FROM known)
""")
def unseen_transitions(spark, sf):
    """States here are (action, horizontal tenth of the image)."""
    rows = dt.annotations(spark, sf).select(
        "video_id", "target_id", "timestamp", "row_ord",
        (F.col("action_id") * 20 + F.floor(F.col("x1") * 10)).cast("int").alias("cell"))
    found = ot.with_previous(tracks.tracks(rows), "cell").select(
        "video_id", "row_ord", "prev_state", "state")
    split = splits.grouped_split(dt.annotations(spark, sf), "video_id")
    train = splits.split_windows(found, split).where(F.col("fold") == "train")
    return ot.unseen_transitions(found, train).select("row_ord", "prev_state", "state")


AUROC_SQL = """
h AS (SELECT {keys}, score, count(*) FILTER (positive) AS pos, count(*) FILTER (NOT positive) AS neg
  FROM {source} GROUP BY ALL),
w AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {keys} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
  sum(pos) OVER (PARTITION BY {keys} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
  sum(neg) OVER (PARTITION BY {keys} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp FROM h),
areas AS (SELECT {keys}, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
  sum(pos * (below + neg / 2.0::DOUBLE))::DOUBLE / (sum(pos) * sum(neg))::DOUBLE AS auroc,
  sum(pos * tp::DOUBLE / (tp + fp)::DOUBLE) / sum(pos)::DOUBLE AS auprc FROM w GROUP BY {keys})
"""


@query("auroc", "," + AUROC_SQL.format(keys="model, fold", source="scores") + """
SELECT model, fold, n_pos, n_neg, round(auroc, 6) AS auroc FROM areas
""", SCORES_VIEWS)
def auroc(spark, sf):
    return om.auroc(scored(spark, sf), ["model", "fold"]).withColumn("auroc", F.round("auroc", 6))


@query("auprc", "," + AUROC_SQL.format(keys="model, fold", source="scores") + """
SELECT model, fold, round(auprc, 6) AS auprc FROM areas
""", SCORES_VIEWS)
def auprc(spark, sf):
    return om.auprc(scored(spark, sf), ["model", "fold"]).withColumn("auprc", F.round("auprc", 6))


THRESHOLD_SQL = """,
vh AS (SELECT model, score, count(*) FILTER (positive) AS pos, count(*) FILTER (NOT positive) AS neg
  FROM scores WHERE fold = 'val' GROUP BY ALL),
vw AS (SELECT *, sum(pos) OVER (PARTITION BY model) AS p,
  sum(pos) OVER (PARTITION BY model ORDER BY score DESC) AS tp,
  sum(neg) OVER (PARTITION BY model ORDER BY score DESC) AS fp FROM vh),
vf AS (SELECT model, score, round(2.0::DOUBLE * tp::DOUBLE / (tp + fp + p)::DOUBLE, 9) AS f1 FROM vw),
thresholds AS (SELECT model, arg_max(score, (f1, score)) AS threshold, max(f1) AS f1 FROM vf GROUP BY model)
"""


@query("threshold", THRESHOLD_SQL + "SELECT model, threshold, f1 FROM thresholds", SCORES_VIEWS)
def threshold(spark, sf):
    rows = scored(spark, sf).where(F.col("fold") == "val")
    return om.select_threshold(rows, ["model"])


@query("quantile_threshold", """,
n AS (SELECT model, score, row_number() OVER (PARTITION BY model ORDER BY score) AS r,
  count(*) OVER (PARTITION BY model) AS c FROM scores WHERE fold = 'val' AND NOT positive)
SELECT model, min(score) AS threshold FROM n WHERE r >= 0.9::DOUBLE * c GROUP BY model
""", SCORES_VIEWS)
def quantile_threshold(spark, sf):
    rows = scored(spark, sf).where(F.col("fold") == "val")
    return om.quantile_threshold(rows, ["model"], 0.9)


@query("precision_recall", THRESHOLD_SQL + """,
c AS (SELECT s.model, count(*) FILTER (s.score >= t.threshold AND positive) AS tp,
  count(*) FILTER (s.score >= t.threshold AND NOT positive) AS fp,
  count(*) FILTER (s.score < t.threshold AND positive) AS fn
  FROM scores s JOIN thresholds t USING (model) WHERE fold = 'test' GROUP BY s.model)
SELECT model, tp, fp, fn, round(tp::DOUBLE / (tp + fp)::DOUBLE, 6) AS precision,
  round(tp::DOUBLE / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp::DOUBLE / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM c
""", SCORES_VIEWS)
def precision_recall(spark, sf):
    rows = scored(spark, sf)
    chosen = om.select_threshold(rows.where(F.col("fold") == "val"), ["model"])
    result = om.precision_recall_f1(rows.where(F.col("fold") == "test"), chosen, ["model"])
    return result.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("model_delta", "," + AUROC_SQL.format(keys="model, fold", source="scores") + """
SELECT fold, round(max(auroc) FILTER (model = 'mahalanobis') - max(auroc) FILTER (model = 'euclidean'), 6) AS delta_auroc,
  round(max(auprc) FILTER (model = 'mahalanobis') - max(auprc) FILTER (model = 'euclidean'), 6) AS delta_auprc
FROM areas GROUP BY fold
""", SCORES_VIEWS)
def model_delta(spark, sf):
    rows = materialize(scored(spark, sf))
    keys = ["model", "fold"]
    both = om.auroc(rows, keys).join(om.auprc(rows, keys), keys)
    delta = om.model_delta(both, "euclidean", "mahalanobis", ["auroc", "auprc"], ["fold"])
    return delta.withColumns({c: F.round(c, 6) for c in ("delta_auroc", "delta_auprc")})


REPLICATES_SQL = """,
reps AS (SELECT *, CAST('0x' || substr(sha256('rep:' || vec_id), 1, 4) AS BIGINT) % 5 AS seed FROM scores), """


def replicates(spark, sf, groups=5):
    """Disjoint replicate groups of the scored vectors, by hash."""
    digest = F.sha2(F.concat(F.lit("rep:"), F.col("vec_id").cast("string")), 256)
    return scored(spark, sf).withColumn(
        "seed", F.conv(F.substring(digest, 1, 4), 16, 10).cast("long") % groups)


@query("leaderboard", REPLICATES_SQL + AUROC_SQL.format(keys="model, seed", source="reps") + """
SELECT model, count(*) AS n_runs, round(avg(auroc), 6) AS auroc_mean, round(stddev_samp(auroc), 6) AS auroc_std,
  round(avg(auprc), 6) AS auprc_mean, round(stddev_samp(auprc), 6) AS auprc_std FROM areas GROUP BY model
""", SCORES_VIEWS)
def leaderboard(spark, sf):
    rows = materialize(replicates(spark, sf))
    keys = ["model", "seed"]
    table = om.auroc(rows, keys).join(om.auprc(rows, keys), keys)
    board = om.leaderboard(table, ["auroc", "auprc"])
    return board.select("model", "n_runs", *[
        F.round(c, 6).alias(c) for c in ("auroc_mean", "auroc_std", "auprc_mean", "auprc_std")])


@query("wilcoxon", f""",
d AS (SELECT vec_id, round(max(score) FILTER (model = 'mahalanobis') / {DIM}, 4)
  - round(max(score) FILTER (model = 'euclidean'), 4) AS d FROM scores GROUP BY vec_id),
nz AS (SELECT round(d, 4) AS d, abs(round(d, 4)) AS size FROM d WHERE round(d, 4) <> 0),
r AS (SELECT *, rank() OVER (ORDER BY size) + (count(*) OVER (PARTITION BY size) - 1) / 2.0::DOUBLE AS rk FROM nz),
t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*) AS c FROM nz GROUP BY size)),
s AS (SELECT count(*) AS n, sum(rk) FILTER (d > 0) AS w_plus, sum(rk) FILTER (d < 0) AS w_minus FROM r),
z AS (SELECT n, w_plus, w_minus, (w_plus - n * (n + 1) / 4.0::DOUBLE)
  / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - ties::DOUBLE / 48.0::DOUBLE) AS z FROM s, t)
SELECT n AS n_pairs, w_plus, w_minus, round(z, 6) AS z, round(""" + om.two_sided_p_sql("z") + """, 6) AS p FROM z
""", SCORES_VIEWS)
def wilcoxon(spark, sf):
    wide = scored(spark, sf).groupBy("vec_id").agg(
        F.max(F.when(F.col("model") == "mahalanobis", F.col("score"))).alias("m"),
        F.max(F.when(F.col("model") == "euclidean", F.col("score"))).alias("e"))
    pairs_ = wide.select(
        F.round(F.round(F.col("m") / DIM, 4) - F.round("e", 4), 4).alias("a"), F.lit(0.0).alias("b"))
    return om.wilcoxon(pairs_, "a", "b").withColumns({c: F.round(c, 6) for c in ("p", "z")})


REPLICATES = 40


@query("wilcoxon_replicates", f""",
reps AS (SELECT *, CAST('0x' || substr(sha256('rep:' || vec_id), 1, 4) AS BIGINT) % {REPLICATES} AS seed FROM scores),
{AUROC_SQL.format(keys="model, seed", source="reps")},
m AS (UNPIVOT (SELECT model, seed, round(auroc, 9) AS auroc, round(auprc, 9) AS auprc FROM areas) ON auroc, auprc INTO NAME metric VALUE area),
nz AS (SELECT metric, seed, round(max(area) FILTER (model = 'mahalanobis') - max(area) FILTER (model = 'euclidean'), 9) AS d
  FROM m GROUP BY ALL HAVING d <> 0 AND NOT isnan(d)),
r AS (SELECT metric, d, 2 * rank() OVER (PARTITION BY metric ORDER BY abs(d)) + count(*) OVER (PARTITION BY metric, abs(d)) - 1 AS rk2 FROM nz),
s AS (SELECT metric, count(*) AS n, list(rk2) AS rk, CAST(sum(rk2) AS BIGINT) AS total, coalesce(sum(rk2) FILTER (d > 0), 0) AS plus2,
  coalesce(sum(rk2) FILTER (d < 0), 0) AS minus2 FROM r GROUP BY metric),
dp(metric, k, f) AS (
  SELECT metric, 0::BIGINT, list_transform(range(total + 1), lambda x: CASE WHEN x = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM s
  UNION ALL
  SELECT dp.metric, k + 1, list_transform(f, lambda x, i: (x + CASE WHEN i > rk[k + 1] THEN f[i - rk[k + 1]] ELSE 0.0::DOUBLE END) / 2)
  FROM dp JOIN s USING (metric) WHERE k < n)
SELECT metric, n AS n_pairs, plus2 / 2 AS w_plus, minus2 / 2 AS w_minus,
  round(least(1, 2 * list_sum(f[1:CAST(least(plus2, minus2) AS BIGINT) + 1])), 6) AS p
FROM s JOIN dp USING (metric) WHERE k = n
""", f"RECURSIVE {SCORES_VIEWS}")
def wilcoxon_replicates(spark, sf):
    """Exact test of the two models over their areas in disjoint replicate groups."""
    rows = materialize(replicates(spark, sf, REPLICATES))
    keys = ["model", "seed"]
    areas = om.auroc(rows, keys).join(om.auprc(rows, keys), keys).select(*keys, F.explode(F.create_map(*[
        x for m in ("auroc", "auprc") for x in (F.lit(m), F.round(m, 9))])).alias("metric", "area"))
    wide = areas.groupBy("metric", "seed").agg(*[F.max(F.when(F.col("model") == m, F.col("area"))).alias(m) for m in MODELS])
    pairs_ = wide.select("metric", F.round(F.col("mahalanobis") - F.col("euclidean"), 9).alias("a"), F.lit(0.0).alias("b"))
    return om.wilcoxon(pairs_, "a", "b", ["metric"]).drop("z").withColumn("p", F.round("p", 6))


@query("delong", """,
n AS (SELECT model, score FROM scores WHERE NOT positive), p AS (SELECT model, score FROM scores WHERE positive),
v10 AS (SELECT s.model, s.vec_id, avg(CASE WHEN n.score < s.score THEN 1.0 WHEN n.score = s.score THEN 0.5 ELSE 0.0 END::DOUBLE) AS v
  FROM scores s JOIN n USING (model) WHERE s.positive GROUP BY ALL),
v01 AS (SELECT s.model, s.vec_id, avg(CASE WHEN p.score > s.score THEN 1.0 WHEN p.score = s.score THEN 0.5 ELSE 0.0 END::DOUBLE) AS v
  FROM scores s JOIN p USING (model) WHERE NOT s.positive GROUP BY ALL),
a AS (SELECT avg(x.v) AS a, avg(y.v) AS b, (var_samp(x.v) + var_samp(y.v) - 2 * covar_samp(x.v, y.v)) / count(*) AS s
  FROM v10 x JOIN v10 y USING (vec_id) WHERE x.model = 'mahalanobis' AND y.model = 'euclidean'),
b AS (SELECT (var_samp(x.v) + var_samp(y.v) - 2 * covar_samp(x.v, y.v)) / count(*) AS s
  FROM v01 x JOIN v01 y USING (vec_id) WHERE x.model = 'mahalanobis' AND y.model = 'euclidean')
SELECT round(a.a, 6) AS auroc_a, round(a.b, 6) AS auroc_b, round(a.s + b.s, 9) AS variance,
  round((a.a - a.b) / sqrt(a.s + b.s), 5) AS z, round(""" + om.two_sided_p_sql("(a.a - a.b) / sqrt(a.s + b.s)") + """, 5) AS p
FROM a, b
""", SCORES_VIEWS)
def delong(spark, sf):
    test = om.delong(scored(spark, sf), "vec_id", "mahalanobis", "euclidean")
    return test.select(
        F.round("auroc_a", 6).alias("auroc_a"), F.round("auroc_b", 6).alias("auroc_b"),
        F.round("variance", 9).alias("variance"), F.round("z", 5).alias("z"),
        F.round(om.two_sided_p("z"), 5).alias("p"))


@query("state_vs_transition", """,
ty AS (SELECT s.*, CASE WHEN label <= 2 THEN 'normal' WHEN label <= 5 THEN 'state' ELSE 'transition' END AS novelty_type FROM scores s),
both_ AS (SELECT model, k.novelty_type, score, positive FROM ty,
  (VALUES ('state'), ('transition')) k(novelty_type) WHERE ty.novelty_type IN ('normal', k.novelty_type)), """
       + AUROC_SQL.format(keys="model, novelty_type", source="both_") + """
SELECT model, novelty_type, n_pos, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc FROM areas
""", SCORES_VIEWS)
def state_vs_transition(spark, sf):
    kind = (
        F.when(F.col("label") <= 2, F.lit("normal")).when(F.col("label") <= 5, F.lit("state"))
        .otherwise(F.lit("transition")))
    report = om.novelty_report(scored(spark, sf).withColumn("novelty_type", kind))
    return report.withColumns({c: F.round(c, 6) for c in ("auroc", "auprc")})


@query("pareto", """,
p AS (SELECT video_id, count(*) AS cost, round(avg(action_id), 6) AS gain FROM annotations GROUP BY video_id)
SELECT video_id, cost, gain FROM p WHERE NOT EXISTS (
  SELECT 1 FROM p q WHERE q.cost <= p.cost AND q.gain >= p.gain AND (q.cost < p.cost OR q.gain > p.gain))
""")
def pareto(spark, sf):
    points = dt.annotations(spark, sf).groupBy("video_id").agg(
        F.count(F.lit(1)).alias("cost"), F.round(F.avg("action_id"), 6).alias("gain"))
    return om.pareto_front(points)


@query("coverage_gaps", """,
res AS (SELECT DISTINCT action_id, video_id, target_id FROM annotations WHERE has_frame AND valid AND row_ord % 2 = 0),
cells AS (SELECT DISTINCT action_id, video_id, target_id FROM annotations)
SELECT * FROM cells EXCEPT SELECT * FROM res
""")
def coverage_gaps(spark, sf):
    """Cells (action, video, target) that occur but have no usable even-numbered row."""
    rows = dt.annotations(spark, sf)
    cell = ["action_id", "video_id", "target_id"]
    results = rows.where(F.col("has_frame") & F.col("valid") & (F.col("row_ord") % 2 == 0))
    return om.coverage_gaps(results, rows, cell)


@query("results_index", """
SELECT model, 'labels' AS setting, fold AS split, 42 AS seed, count(*) AS n_rows,
  min(score) AS min_score, max(score) AS max_score FROM scores GROUP BY ALL
""", SCORES_VIEWS)
def results_index(spark, sf):
    """Scores persisted by run key, read back and indexed."""
    from ..session import scratch_path
    from ..sources import tables

    path = scratch_path(spark, "scores")
    rows = scored(spark, sf).select(
        "model", F.lit("labels").alias("setting"), F.col("fold").alias("split"),
        F.lit(42).alias("seed"), "vec_id", "score")
    tables.write_scores(rows, path)
    return tables.results_index(spark.read.parquet(path))
