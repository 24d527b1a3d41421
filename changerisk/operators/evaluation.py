"""Exact classifier metrics over scored rows.

Scored rows have a label ``y`` (0/1), a score ``p`` and any grouping columns (model, split ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from changerisk.functions.rounding import ratio, round_exact
from changerisk.functions.scoring import error_type
from changerisk.operators.ordered import exact_medians, join_groups, running_totals
from changerisk.schema import PRODUCTION_THRESHOLD, SWEEP_PERCENT
from changerisk.session import materialize

THRESHOLDS = [pct / 100 for pct in SWEEP_PERCENT]
# Recall and precision floors of the two operating-point rules.
SELECTION_FLOORS = (0.75, 0.70)
BENCHMARK_FLOORS = (0.70, 0.60)
PROMOTION_GAIN = 0.03


def derived_metrics(digits: int = 4) -> dict[str, Column]:
    """Metrics from the columns tp, fp, tn, fn; a zero denominator gives 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    total = tp + fp + tn + fn
    raw = {
        "positive_prevalence": ratio(tp + fn, total),
        "predicted_positive_rate": ratio(tp + fp, total),
        "accuracy": ratio(tp + tn, total),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
    }
    out = {k: round_exact(v, digits) for k, v in raw.items()}
    return {"predicted_positives": tp + fp, "total_samples": total, **out}


def threshold_sweep(
    scored: DataFrame, groups: list[str], thresholds: list[float] | None = None
) -> DataFrame:
    """Confusion counts and metrics of every group at every threshold, from one pass.

    All thresholds are counted side by side in one aggregation, so rows are neither multiplied
    by the thresholds nor shuffled before they are counted.
    """
    y, p = F.col("y"), F.col("p")
    cells = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            F.count_if((y == 1) & (p >= t)).alias("tp"),
            F.count_if((y == 0) & (p >= t)).alias("fp"),
            F.count_if((y == 0) & ~(p >= t)).alias("tn"),
            F.count_if((y == 1) & ~(p >= t)).alias("fn"),
        )
        for t in (thresholds or THRESHOLDS)
    ]
    counted = scored.groupBy(*groups).agg(F.array(*cells).alias("_cells"))
    return counted.select(*groups, F.inline("_cells")).withColumns(derived_metrics())


def confusion(scored: DataFrame, groups: list[str], threshold: float) -> DataFrame:
    return threshold_sweep(scored, groups, [threshold])


def ranking_metrics(scored: DataFrame, groups: list[str], digits: int | None = 4) -> DataFrame:
    """ROC-AUC (ties count one half) and average precision per group.

    Rows are reduced to distinct scores before anything is ordered. A group with one class or one
    score gets 0.5 and its positive rate.
    """
    return _ranking(_by_score(scored, groups), groups, digits)


def _by_score(scored: DataFrame, groups: list[str]) -> DataFrame:
    """Positives and negatives per distinct score: all that the metrics of a group need."""
    return scored.groupBy(*groups, "p").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
    )


def _ranking(counted: DataFrame, groups: list[str], digits: int | None = 4) -> DataFrame:
    ranked = running_totals(counted, groups, ["p"], {"cpos": "pos", "cneg": "neg"})
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    below = (F.col("cneg") - F.col("neg")).cast("double")
    tp = (F.col("cpos_total") - F.col("cpos")).cast("double") + pos
    fp = (F.col("cneg_total") - F.col("cneg")).cast("double") + neg
    summed = ranked.groupBy(*groups).agg(
        F.sum(pos * below + pos * neg / 2).alias("_u"),
        F.sum(ratio(pos * tp, tp + fp)).alias("_ap"),
        F.max("cpos_total").alias("_p"),
        F.max("cneg_total").alias("_n"),
        F.count("*").alias("_scores"),
    )
    p, n = F.col("_p").cast("double"), F.col("_n").cast("double")
    usable = (p > 0) & (n > 0) & (F.col("_scores") > 1)
    auc = F.when(usable, F.try_divide(F.col("_u"), p * n)).otherwise(0.5)
    prevalence = round_exact(ratio(p, p + n), 4)
    ap = F.when(usable, F.try_divide(F.col("_ap"), p)).otherwise(prevalence)
    if digits is not None:
        auc, ap = round_exact(auc, digits), round_exact(ap, digits)
    return summed.select(*groups, auc.alias("roc_auc"), ap.alias("pr_auc"))


def brier_score(scored: DataFrame, groups: list[str]) -> DataFrame:
    gap = F.col("p") - F.col("y")
    return scored.groupBy(*groups).agg(round_exact(F.avg(gap * gap), 4).alias("brier_score"))


def probability_stats(scored: DataFrame, groups: list[str]) -> DataFrame:
    """Min, max, mean and exact median of the scores (4 decimals)."""
    basic = scored.groupBy(*groups).agg(
        round_exact(F.min("p"), 4).alias("min"),
        round_exact(F.max("p"), 4).alias("max"),
        round_exact(F.avg("p"), 4).alias("mean"),
    )
    medians = exact_medians(scored, groups, "p").withColumn("median", round_exact(F.col("median"), 4))
    return join_groups(basic, medians, groups, "left")


def detailed_metrics(scored: DataFrame, groups: list[str], threshold: float) -> DataFrame:
    """The full metric record of every group at one threshold, from one pass over the scores."""
    counted = materialize(_by_score(scored, groups))
    p, pos, neg = F.col("p"), F.col("pos"), F.col("neg")
    total = lambda on, n: F.coalesce(F.sum(F.when(on, n)), F.lit(0).cast("bigint"))
    at = F.lit(float(threshold))
    gaps = F.sum(pos * (1 - p) * (1 - p) + neg * p * p) / F.sum(F.when(p.isNotNull(), pos + neg))
    counts = counted.groupBy(*groups).agg(
        total(p >= at, pos).alias("tp"), total(p >= at, neg).alias("fp"),
        total(p < at, neg).alias("tn"), total(p < at, pos).alias("fn"),
        round_exact(gaps, 4).alias("brier_score"),
    )
    metrics = counts.select(*groups, at.alias("threshold"), "tp", "fp", "tn", "fn", "brier_score").withColumns(derived_metrics())
    ordered = [*groups, "threshold", "tp", "fp", "tn", "fn", *derived_metrics()]
    joined = join_groups(metrics.select(*ordered, "brier_score"), _ranking(counted, groups), groups)
    return joined.select(*ordered, "roc_auc", "pr_auc", "brier_score")


def operating_points(
    sweep: DataFrame,
    groups: list[str],
    floors: tuple[float, float] = BENCHMARK_FLOORS,
    production: float = PRODUCTION_THRESHOLD,
) -> DataFrame:
    """Named thresholds of each group's sweep.

    max_f1; high_recall (best F1 above the recall floor, else the best recall); balanced (smallest
    gap of precision and recall, both above 0); high_precision (best F1 above the precision floor,
    else the best precision among points that predict anything); and the production threshold.
    Ties go to the lowest threshold. One aggregation, no sorting.
    """
    names = ["threshold", "f1", "precision", "recall", "tp", "fp", "tn", "fn"]
    row = F.struct(*names)
    t, f1, prec, rec = (F.col(c) for c in ("threshold", "f1", "precision", "recall"))

    def best(metric: Column, allowed: Column | None = None) -> Column:
        order = F.struct(metric.alias("m"), (-t).alias("t"))
        return F.max_by(row, order if allowed is None else F.when(allowed, order))

    max_f1 = best(f1)
    points = {
        "max_f1": max_f1,
        "high_recall": F.coalesce(best(f1, rec >= floors[0]), best(rec)),
        "balanced": F.coalesce(
            best(-F.abs(round_exact(prec - rec, 4)), (prec > 0) & (rec > 0)), max_f1
        ),
        "high_precision": F.coalesce(
            best(f1, prec >= floors[1]), best(prec, F.col("tp") + F.col("fp") > 0), max_f1
        ),
        "production": best(f1, t == production),
    }
    picked = sweep.groupBy(*groups).agg(
        F.array(
            *[F.struct(F.lit(n).alias("point"), c.alias("at")) for n, c in points.items()]
        ).alias("_points")
    )
    return picked.select(*groups, F.inline("_points")).select(*groups, "point", "at.*")


def rank_candidates(candidates: DataFrame, families: list[str], tie: str = "cfg_id") -> DataFrame:
    """Order configurations by PR-AUC, ROC-AUC and F1; the first listed wins a tie.

    The rows are one per fitted configuration, a number set by the grid.
    """
    w = Window.partitionBy(*families).orderBy(F.desc("pr_auc"), F.desc("roc_auc"), F.desc("f1"), tie)
    return candidates.withColumn("candidate_rank", F.row_number().over(w))


def error_rows(scored: DataFrame, threshold: float = PRODUCTION_THRESHOLD) -> DataFrame:
    """Add the predicted label and the confusion cell of every row."""
    predicted = (F.col("p") >= threshold).cast("int")
    return scored.withColumn("predicted", predicted).withColumn(
        "error_type", error_type(F.col("y"), F.col("predicted"))
    )


def error_samples(
    errors: DataFrame, features: DataFrame, keys: list[str], groups: list[str], order: list[str], n: int = 3
) -> DataFrame:
    """First ``n`` rows of each wrong cell with their features.

    The rank limit is applied before the join, on the map side too.
    """
    w = Window.partitionBy(*groups, "error_type").orderBy(*order)
    first = (
        errors.where(F.col("error_type").isin("FN", "FP"))
        .withColumn("sample_no", F.row_number().over(w))
        .where(F.col("sample_no") <= n)
    )
    return first.join(features, keys)


def majority_label(train: DataFrame) -> int:
    """Most frequent training label as a driver-side number; a tie gives 0."""
    row = train.agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
    ).first()
    return int(row["pos"] > row["neg"])


def majority_baseline(evaluated: DataFrame, groups: list[str], majority: int) -> DataFrame:
    """Metrics of always predicting ``majority``."""
    constant = evaluated.withColumn("p", F.lit(float(majority)))
    return (
        confusion(constant, groups, 0.5)
        .drop("threshold")
        .withColumns({"majority": F.lit(majority), "roc_auc": F.lit(0.5)})
    )


def metric_deltas(
    metrics: DataFrame, groups: list[str], names: list[str], before: str = "validation", after: str = "test"
) -> DataFrame:
    """``after`` minus ``before`` of each metric (4 decimals)."""

    def at(split: str, name: str) -> Column:
        return F.max(F.when(F.col("split") == split, F.col(name)))

    return metrics.groupBy(*groups).agg(
        *[round_exact(at(after, m) - at(before, m), 4).alias(f"{m}_diff") for m in names]
    )


def champion_decision(
    metrics: DataFrame, champion: str, gain: float = PROMOTION_GAIN, require_test_gain: bool = True
) -> DataFrame:
    """Compare each challenger with the champion on validation (and test) PR-AUC."""
    at = {s: F.max(F.when(F.col("split") == s, F.col("pr_auc"))) for s in ("validation", "test")}
    wide = metrics.groupBy("model").agg(*[c.alias(s) for s, c in at.items()])
    few = Window.partitionBy(F.lit(0))  # one row per model

    def of_champion(name: str) -> Column:
        return F.max(F.when(F.col("model") == champion, F.col(name))).over(few)

    improved = F.col("validation_gain") >= gain
    if require_test_gain:
        improved = improved & (F.col("test") > F.col("champion_test"))
    return (
        wide.withColumns(
            {"champion_validation": of_champion("validation"), "champion_test": of_champion("test")}
        )
        .where(F.col("model") != champion)
        .withColumn("validation_gain", round_exact(F.col("validation") - F.col("champion_validation"), 4))
        .withColumn("is_meaningful", improved)
        .withColumn("decision", F.when(improved, "propose_promotion").otherwise("keep_champion"))
    )


def comparison_table(anchor: DataFrame, candidates: DataFrame, winner: Column) -> DataFrame:
    """Anchor and candidates in one table; metrics one side lacks stay null."""
    return (
        anchor.withColumn("is_production", F.lit(True))
        .unionByName(candidates.withColumn("is_production", F.lit(False)), allowMissingColumns=True)
        .withColumn("is_winner", F.coalesce(winner & ~F.col("is_production"), F.lit(False)))
    )


def tidy_metrics(wide: DataFrame, ids: list[str], names: list[str]) -> DataFrame:
    """Long form (ids, metric, value) without the missing values."""
    doubles = wide.select(*ids, *[F.col(n).cast("double").alias(n) for n in names])
    return doubles.unpivot(ids, names, "metric", "value").where(F.col("value").isNotNull())


def markdown_summary(comparison: DataFrame) -> DataFrame:
    """The comparison as Markdown, one line per model with its rank."""
    num = lambda c: F.when(
        F.col(c).isNotNull(), F.format_string("%.4f", F.col(c))
    ).otherwise("n/a")
    line = F.concat(
        F.lit("| "), F.concat_ws(" | ", F.col("model"), num("pr_auc"), num("roc_auc"), num("f1"),
                                 F.when(F.col("is_winner"), "yes").otherwise("no")), F.lit(" |")
    )
    return comparison.select("model", line.alias("markdown"))
