"""Detection metrics over scored rows.

All rank-based metrics first fold rows into one row per (keys, score), which
removes hot ties, and then use ``cumulative_by_value``; nothing sorts all
scores in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import cumulative_by_value, null_safe_join


def score_histogram(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Positives and negatives per distinct score; needs ``score`` and ``positive``."""
    return scored.groupBy(*keys, "score").agg(
        F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg"))


def auroc(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the ROC curve; ties count half."""
    ranked = cumulative_by_value(score_histogram(scored, keys), "score", {"neg": "below"}, keys)
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    pairs = F.sum("pos") * F.sum("neg")
    return ranked.groupBy(*keys).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        F.when(pairs > 0, wins / pairs).alias("auroc"),
    )


def auprc(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Average precision."""
    ranked = cumulative_by_value(
        score_histogram(scored, keys), "score", {"pos": "tp0", "neg": "fp0"}, keys, descending=True)
    tp, fp = F.col("tp0") + F.col("pos"), F.col("fp0") + F.col("neg")
    return ranked.groupBy(*keys).agg(
        F.when(F.sum("pos") > 0, F.sum(F.col("pos") * tp / (tp + fp)) / F.sum("pos")).alias("auprc"))


def select_threshold(validation: DataFrame, keys: list[str]) -> DataFrame:
    """The threshold with the best F1 on validation rows; ties take the highest."""
    ranked = cumulative_by_value(
        score_histogram(validation, keys), "score", {"pos": "tp0", "neg": "fp0"}, keys, descending=True)
    tp, fp = F.col("tp0") + F.col("pos"), F.col("fp0") + F.col("neg")
    # 2*tp / (tp + fp + all positives): the same for every threshold but tp, fp.
    totals = validation.groupBy(*keys).agg(F.count_if("positive").alias("all_pos"))
    scored = null_safe_join(ranked, totals, keys).withColumn(
        "f1", F.lit(2.0) * tp / (tp + fp + F.col("all_pos")))
    return scored.groupBy(*keys).agg(
        F.max(F.struct(F.round("f1", 9).alias("f1"), F.col("score"))).alias("_best")
    ).select(*keys, F.col("_best.score").alias("threshold"), F.col("_best.f1").alias("f1"))


def quantile_threshold(validation: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The smallest score with at least ``share`` of the normal rows at or below it."""
    hist = score_histogram(validation.where(~F.col("positive")), keys)
    ranked = cumulative_by_value(hist, "score", {"neg": "below"}, keys)
    totals = hist.groupBy(*keys).agg(F.sum("neg").alias("total"))
    reached = F.col("below") + F.col("neg") >= F.lit(share) * F.col("total")
    return null_safe_join(ranked, totals, keys).where(reached).groupBy(*keys).agg(
        F.min("score").alias("threshold"))


def precision_recall_f1(scored: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and rates at each key's chosen threshold."""
    flagged = null_safe_join(scored, thresholds.select(*keys, "threshold"), keys).withColumn(
        "flag", F.col("score") >= F.col("threshold"))
    counts = flagged.groupBy(*keys).agg(
        F.count_if(F.col("flag") & F.col("positive")).alias("tp"),
        F.count_if(F.col("flag") & ~F.col("positive")).alias("fp"),
        F.count_if(~F.col("flag") & F.col("positive")).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({
        "precision": F.when(tp + fp > 0, tp / (tp + fp)),
        "recall": F.when(tp + fn > 0, tp / (tp + fn)),
        "f1": F.when(tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)),
    })


def false_alert_rate(flagged: DataFrame, camera: str = "video_id") -> DataFrame:
    """False alerts per observed hour and day of each camera.

    Needs ``timestamp`` (seconds), ``flag`` and ``positive``.
    """
    per_camera = flagged.groupBy(camera).agg(
        F.count_if(F.col("flag") & ~F.col("positive")).alias("false_alerts"),
        ((F.max("timestamp") - F.min("timestamp")) / 3600).alias("hours"),
    )
    observed = F.col("hours") > 0
    return per_camera.withColumns({
        "per_hour": F.when(observed, F.col("false_alerts") / F.col("hours")),
        "per_day": F.when(observed, F.col("false_alerts") / F.col("hours") * 24),
    })


def false_event_rate(events: DataFrame, observed: DataFrame, camera: str = "video_id") -> DataFrame:
    """False events per observed hour and camera-day: an event counts once, however many rows it has.

    ``events`` has ``matched`` (does it overlap the truth), ``observed`` the ``seconds`` watched of
    every camera; a camera without events has none.
    """
    false = events.where(~F.col("matched")).groupBy(camera).agg(F.count(F.lit(1)).alias("false_events"))
    hours = F.col("seconds") / 3600
    return observed.join(false, camera, "left").select(
        camera, F.coalesce("false_events", F.lit(0)).cast("long").alias("false_events"), hours.alias("hours"),
        F.when(hours > 0, F.coalesce("false_events", F.lit(0)) / hours).alias("per_hour"),
        F.when(hours > 0, F.coalesce("false_events", F.lit(0)) / hours * 24).alias("per_day"))


def model_delta(metrics: DataFrame, base: str, other: str, names: list[str], by: list[str]) -> DataFrame:
    """Metric differences other - base, one row per ``by``."""
    picked = [
        F.max(F.when(F.col("model") == model, F.col(name))).alias(f"_{model}_{name}")
        for name in names for model in (base, other)
    ]
    grouped = metrics.groupBy(*by).agg(*picked)
    return grouped.select(
        *by, *[(F.col(f"_{other}_{n}") - F.col(f"_{base}_{n}")).alias(f"delta_{n}") for n in names])


def leaderboard(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Mean and sample deviation over seeds of each metric, one row per model."""
    columns = []
    for name in names:
        columns += [F.avg(name).alias(f"{name}_mean"), F.stddev(name).alias(f"{name}_std")]
    return metrics.groupBy("model").agg(F.count(F.lit(1)).alias("n_runs"), *columns)


def novelty_report(scored: DataFrame, normal: str = "normal") -> DataFrame:
    """AUROC and AUPRC per model and novelty type, each against all normal rows.

    Normal scores count once per type: they are folded into a histogram first
    and only that is repeated, over the list of types.
    """
    hist = scored.groupBy("model", "novelty_type", "score").agg(F.count(F.lit(1)).alias("n"))
    types = hist.where(F.col("novelty_type") != normal).select("model", "novelty_type").distinct()
    normals = hist.where(F.col("novelty_type") == normal).select(
        "model", "score", F.col("n").alias("neg"))
    normals = null_safe_join(normals, types, ["model"])
    novel = hist.where(F.col("novelty_type") != normal).select(
        "model", "novelty_type", "score", F.col("n").alias("pos"))
    keys = ["model", "novelty_type"]
    merged = novel.select(*keys, "score", "pos", F.lit(0).cast("long").alias("neg")).unionByName(
        normals.select(*keys, "score", F.lit(0).cast("long").alias("pos"), "neg")
    ).groupBy(*keys, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    up = cumulative_by_value(merged, "score", {"neg": "below", "pos": "pos_below"}, keys)
    totals = merged.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    tp = F.col("P") - F.col("pos_below")
    fp = F.col("N") - F.col("below")
    return null_safe_join(up, totals, keys).groupBy(*keys).agg(
        F.sum("pos").alias("n_pos"),
        (F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / F.max("P") / F.max("N")).alias("auroc"),
        (F.sum(F.when(F.col("pos") > 0, F.col("pos") * tp / (tp + fp))) / F.max("P")).alias("auprc"),
    )


# A published rational approximation of erfc (error below 1.5e-7).
ERFC_SLOPE = 0.3275911
ERFC_TERMS = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def two_sided_p(z: Column | str) -> Column:
    """Two-sided normal tail of a z statistic, in column functions; NULL stays NULL."""
    x = F.abs(F.col(z) if isinstance(z, str) else z) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERFC_SLOPE) * x)
    total = F.lit(0.0)
    for term in reversed(ERFC_TERMS):
        total = (total + F.lit(term)) * t
    return total * F.exp(-x * x)


def two_sided_p_sql(z: str) -> str:
    """``two_sided_p`` in SQL."""
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + {ERFC_SLOPE}::DOUBLE * {x}))"
    total = "0.0::DOUBLE"
    for term in reversed(ERFC_TERMS):
        total = f"(({total} + {term}::DOUBLE) * {t})"
    return f"({total} * exp(-{x} * {x}))"


#: Up to so many pairs the signed-rank test takes its p from the exact null distribution.
EXACT_PAIRS = 50


def signed_rank_p(ranks: Column, smaller: Column) -> Column:
    """Two-sided exact p of a signed-rank sum.

    ``ranks`` is the array of doubled ranks (whole numbers also with ties), ``smaller`` the
    smaller of the two doubled rank sums. Under the null every sign is a fair coin: the
    distribution of the sum is built rank by rank, as an array over all sums.
    """
    sums = F.aggregate(ranks, F.lit(0), lambda total, r: total + r)
    start = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), sums))
    chances = F.aggregate(ranks, start, lambda p, r: F.zip_with(
        p, F.slice(F.concat(F.array_repeat(F.lit(0.0), r), p), F.lit(1), F.size(p)), lambda x, y: (x + y) / 2))
    tail = F.aggregate(F.slice(chances, F.lit(1), smaller + 1), F.lit(0.0), lambda total, x: total + x)
    return F.least(F.lit(1.0), 2 * tail)


def wilcoxon(pairs: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Signed-rank test of a - b: rank sums, z with tie correction and two-sided p, per group.

    Zero, NULL and NaN differences are left out and tied sizes share their mean rank. Up to
    ``EXACT_PAIRS`` pairs p is exact, beyond that the normal tail of z. A group without any
    difference has no row; without ``by`` there is one row, with NULLs in that case.
    """
    by = list(by)
    diff = F.col(a) - F.col(b)
    hist = (
        pairs.select(*by, diff.alias("d")).where((F.col("d") != 0) & ~F.isnan("d"))
        .groupBy(*by, F.abs("d").alias("size"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("n_plus"))
    )
    ranked = cumulative_by_value(hist, "size", {"n": "below"}, by)
    rank = F.col("below") + (F.col("n") + 1) / 2
    n = F.col("n_pairs")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    # Only ranks up to the limit are gathered, so the array is short in groups of any size.
    doubled = F.when(F.col("below") + F.col("n") <= EXACT_PAIRS, F.array_repeat(
        (2 * F.col("below") + F.col("n") + 1).cast("int"), F.col("n").cast("int")))
    smaller = (2 * F.least("w_plus", "w_minus")).cast("int")
    return (
        ranked.groupBy(*by).agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_pairs"),
            F.sum(rank * F.col("n_plus")).alias("w_plus"),
            F.sum(rank * (F.col("n") - F.col("n_plus"))).alias("w_minus"),
            F.sum((F.pow("n", F.lit(3)) - F.col("n"))).alias("ties"),
            F.flatten(F.collect_list(doubled)).alias("_ranks"),
        )
        .withColumn("z", F.when(variance > 0, (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(variance)))
        .withColumn("p", F.when(n.between(1, EXACT_PAIRS), signed_rank_p(F.col("_ranks"), smaller))
                    .when(n > EXACT_PAIRS, two_sided_p("z")))
        .drop("ties", "_ranks")
    )


def placements(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Per row, the share of the opposite class it beats (ties count half)."""
    hist = score_histogram(scored, keys)
    ranked = cumulative_by_value(hist, "score", {"neg": "neg_below", "pos": "pos_below"}, keys)
    totals = hist.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    table = null_safe_join(ranked, totals, keys).select(
        *keys, "score",
        ((F.col("neg_below") + F.col("neg") / 2) / F.col("N")).alias("_v10"),
        ((F.col("P") - F.col("pos_below") - F.col("pos") / 2) / F.col("P")).alias("_v01"),
    )
    return null_safe_join(scored, table, [*keys, "score"]).withColumn(
        "placement", F.when(F.col("positive"), F.col("_v10")).otherwise(F.col("_v01"))
    ).drop("_v10", "_v01")


def delong(scored: DataFrame, unit: str, a: str, b: str) -> DataFrame:
    """Paired test of two models' AUROC on the same units."""
    placed = placements(scored.where(F.col("model").isin(a, b)), ["model"])
    wide = placed.groupBy(unit, "positive").agg(
        F.max(F.when(F.col("model") == a, F.col("placement"))).alias("a"),
        F.max(F.when(F.col("model") == b, F.col("placement"))).alias("b"),
    )
    parts = []
    for label, is_pos in (("p", F.col("positive")), ("n", ~F.col("positive"))):
        va, vb = F.when(is_pos, F.col("a")), F.when(is_pos, F.col("b"))
        parts += [
            F.count(va).alias(f"{label}_n"), F.avg(va).alias(f"{label}_a"), F.avg(vb).alias(f"{label}_b"),
            F.var_samp(va).alias(f"{label}_vaa"), F.var_samp(vb).alias(f"{label}_vbb"),
            F.covar_samp(va, vb).alias(f"{label}_vab"),
        ]

    def spread(label: str):
        return (F.col(f"{label}_vaa") + F.col(f"{label}_vbb") - 2 * F.col(f"{label}_vab")) / F.col(f"{label}_n")

    variance = spread("p") + spread("n")
    delta = F.col("p_a") - F.col("p_b")
    return wide.agg(*parts).select(
        F.col("p_a").alias("auroc_a"), F.col("p_b").alias("auroc_b"),
        variance.alias("variance"),
        F.when(variance > 0, delta / F.sqrt(variance)).alias("z"),
    )


def pareto_front(points: DataFrame, cost: str = "cost", gain: str = "gain") -> DataFrame:
    """Points no other point beats on both axes (less cost and more gain).

    Per cost only the best gain matters; a point stays if that beats every gain
    at lower cost. That is a running maximum, not an all-pairs comparison.
    """
    best = points.groupBy(cost).agg(F.max(gain).alias("_best"))
    ranked = cumulative_by_value(best, cost, {"_best": "_cheaper"}, kind="max")
    front = ranked.where(F.col("_cheaper").isNull() | (F.col("_best") > F.col("_cheaper")))
    return null_safe_join(
        points, front.select(cost, F.col("_best").alias(gain)), [cost, gain], "left_semi")


def coverage_gaps(results: DataFrame, spec: DataFrame, cell: list[str], fail: bool = False) -> DataFrame:
    """Declared cells without a result; with ``fail`` any gap is an error."""
    gaps = spec.select(*cell).distinct().join(results.select(*cell), cell, "left_anti")
    if fail:
        missing = gaps.limit(20).collect()
        if missing:
            raise ValueError(f"cells without a result: {[tuple(r) for r in missing]} ...")
    return gaps

