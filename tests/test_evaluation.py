import random

import pytest
from pyspark.sql import functions as F

from changerisk.operators import evaluation as ev, models as md
from changerisk.schema import FEATURES, TARGET

Y1, P1 = [1, 0, 1, 0, 1, 0, 0, 1], [0.9, 0.1, 0.8, 0.2, 0.4, 0.3, 0.1, 0.75]
Y2, P2 = [1, 0, 1, 0, 1, 0, 1, 0], [0.85, 0.15, 0.75, 0.30, 0.65, 0.20, 0.90, 0.10]


def scored(spark, **models):
    rows = [(m, int(y), float(p)) for m, (ys, ps) in models.items() for y, p in zip(ys, ps, strict=True)]
    return spark.createDataFrame(rows, "model string, y int, p double")


def auc(ys, ps):
    pos = [p for y, p in zip(ys, ps) if y]
    neg = [p for y, p in zip(ys, ps) if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def avg_precision(ys, ps):
    total, last = 0.0, 0.0
    for t in sorted(set(ps), reverse=True):
        tp = sum(y for y, p in zip(ys, ps) if p >= t)
        n = sum(p >= t for p in ps)
        total += (tp / sum(ys) - last) * tp / n
        last = tp / sum(ys)
    return total


def test_ranking_metrics_against_brute_force(spark):
    ties = ([1, 0, 1, 0, 0, 1], [0.5, 0.5, 0.5, 0.2, 0.7, 0.2])
    df = scored(spark, a=(Y1, P1), b=(Y2, P2), ties=ties, one_class=([1, 1], [0.1, 0.9]), constant=([1, 0, 0], [0.4] * 3))
    got = {r.model: r for r in ev.ranking_metrics(df, ["model"], None).collect()}
    for name, (ys, ps) in {"a": (Y1, P1), "b": (Y2, P2), "ties": ties}.items():
        assert got[name].roc_auc == pytest.approx(auc(ys, ps))
        assert got[name].pr_auc == pytest.approx(avg_precision(ys, ps))
    assert (got["one_class"].roc_auc, got["one_class"].pr_auc) == (0.5, 1.0)
    assert (got["constant"].roc_auc, got["constant"].pr_auc) == (0.5, 0.3333)


def test_detailed_metrics(spark):
    r = ev.detailed_metrics(scored(spark, a=(Y1, P1)), ["model"], 0.5).first()
    assert (r.tp, r.fp, r.tn, r.fn) == (3, 0, 4, 1)
    assert (r.accuracy, r.precision, r.recall, r.f1) == (0.875, 1.0, 0.75, 0.8571)
    assert r.brier_score == round(sum((p - y) ** 2 for y, p in zip(Y1, P1)) / 8, 4)
    assert (r.positive_prevalence, r.predicted_positive_rate) == (0.5, 0.375)


def test_sweep_and_points_against_brute_force(spark):
    df = scored(spark, a=(Y1, P1), b=(Y2, P2), none=([0, 0, 1], [0.01, 0.02, 0.03]))
    sweep = ev.threshold_sweep(df, ["model"])
    assert sweep.where("model = 'a'").count() == 17
    for floors in (ev.SELECTION_FLOORS, ev.BENCHMARK_FLOORS):
        got = {(r.model, r.point): r.threshold for r in ev.operating_points(sweep, ["model"], floors).collect()}
        rows = {}
        for r in sweep.orderBy("threshold").collect():
            rows.setdefault(r.model, []).append(r)
        for m, rs in rows.items():
            first = lambda xs, key: max(xs, key=key).threshold
            f1 = lambda x: x.f1
            want = {"max_f1": first(rs, f1), "production": 0.35}
            rec = [x for x in rs if x.recall >= floors[0]]
            want["high_recall"] = first(rec, f1) if rec else first(rs, lambda x: x.recall)
            both = [x for x in rs if x.precision > 0 and x.recall > 0]
            want["balanced"] = first(both, lambda x: -abs(x.precision - x.recall)) if both else want["max_f1"]
            prec = [x for x in rs if x.precision >= floors[1]]
            some = [x for x in rs if x.predicted_positives > 0]
            want["high_precision"] = (
                first(prec, f1) if prec else first(some, lambda x: x.precision) if some else want["max_f1"]
            )
            assert {p: t for (mm, p), t in got.items() if mm == m} == want


def test_majority_and_deltas(spark):
    df = scored(spark, a=([0, 0, 1], [0.1, 0.2, 0.9]))
    assert ev.majority_label(df) == 0
    assert ev.majority_label(scored(spark, a=([0, 1], [0.1, 0.2]))) == 0
    r = ev.majority_baseline(df, ["model"], 0).first()
    assert (r.tp, r.fp, r.tn, r.fn, r.accuracy, r.f1, r.roc_auc) == (0, 0, 2, 1, 0.6667, 0.0, 0.5)


def test_champion_decision(spark):
    rows = [("champ", "validation", 0.622), ("champ", "test", 0.3086), ("small", "validation", 0.6293), ("small", "test", 0.3535),
            ("big", "validation", 0.66), ("big", "test", 0.31), ("falls", "validation", 0.70), ("falls", "test", 0.30)]
    df = spark.createDataFrame(rows, "model string, split string, pr_auc double")
    got = {r.model: (r.validation_gain, r.decision) for r in ev.champion_decision(df, "champ").collect()}
    assert got == {"small": (0.0073, "keep_champion"), "big": (0.038, "propose_promotion"), "falls": (0.078, "keep_champion")}
    loose = {r.model: r.is_meaningful for r in ev.champion_decision(df, "champ", require_test_gain=False).collect()}
    assert loose["falls"]


def test_probability_stats_median(spark):
    r = ev.probability_stats(scored(spark, a=(Y1, P1)), ["model"]).first()
    assert (r.min, r.max, r.mean, r.median) == (0.1, 0.9, 0.4438, 0.35)


def test_family_search_takes_the_best_of_all_families(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        x = [rng.random() for _ in FEATURES]
        rows.append((f"h{i}", ("train", "validation", "test")[i % 3], int((x[0] > 0.5) != (x[1] > 0.5)), *x))
    splits = spark.createDataFrame(rows, f"full_hash string, split string, {TARGET} int, " + ", ".join(f"{f} double" for f in FEATURES))
    splits = splits.select("*", *[F.col(f).alias(f"{f}_z") for f in FEATURES]).cache()
    grids = {
        "logistic": [{"C": 0.1}, {"C": 0.1}],
        "forest": [{"trees": 3, "depth": 1}, {"trees": 10, "depth": 5}],
        "boosted": [{"rounds": 4, "depth": 3}],
    }
    ranked, final, model = md.family_search(splits, ["full_hash"], grids)
    found = sorted(ranked.collect(), key=lambda r: r.overall_rank)
    assert [r.overall_rank for r in found] == [1, 2, 3, 4, 5]
    merits = [(r.pr_auc, r.roc_auc, r.f1) for r in found]
    assert merits == sorted(merits, reverse=True)
    # Two targets that no line divides: a tree wins, and equal configurations keep the order of the grid.
    assert found[0].family != "logistic"
    equal = [r.cfg_id for r in found if r.family == "logistic"]
    assert equal == ["logistic_cfg_1", "logistic_cfg_2"]
    for family in grids:
        assert [r.candidate_rank for r in found if r.family == family] == list(range(1, len(grids[family]) + 1))
    # What the winner scores, counted plainly at the threshold of validation.
    best, got = found[0], final.first()
    for split, r in (("validation", best), ("test", got)):
        scores = md.positive_score(model, splits.where(F.col("split") == split), ["full_hash"]).collect()
        cell = lambda y, up: sum(s.y == y and (s.p >= best.threshold) == up for s in scores)  # noqa: E731, B023
        assert (r.tp, r.fp, r.tn, r.fn) == (cell(1, True), cell(0, True), cell(0, False), cell(1, False))
    assert (got.cfg_id, got.threshold) == (best.cfg_id, best.threshold)
