"""Queries of evaluation, selection and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from changerisk.functions import scoring as fs
from changerisk.operators import evaluation as ev, models as md, stats as st
from changerisk.operators.ordered import join_groups
from changerisk.plans import q_features as qf
from changerisk.plans.adapters import with_adapters as wa
from changerisk.plans.catalog import query
from changerisk.plans.q_scalar import ERR
from changerisk.schema import FEATURES
from changerisk.session import materialize

c = F.col
G = ["model", "split"]

# --- oracle parts ----------------------------------------------------------------------------
DERIVED = """tp + fp AS predicted_positives, tp + fp + tn + fn AS total_samples,
 (CAST(printf('%.4f', coalesce(CAST(tp + fn AS DOUBLE) / nullif(tp + fp + tn + fn, 0), 0)) AS DOUBLE) + 0.0::DOUBLE) AS positive_prevalence,
 (CAST(printf('%.4f', coalesce(CAST(tp + fp AS DOUBLE) / nullif(tp + fp + tn + fn, 0), 0)) AS DOUBLE) + 0.0::DOUBLE) AS predicted_positive_rate,
 (CAST(printf('%.4f', coalesce(CAST(tp + tn AS DOUBLE) / nullif(tp + fp + tn + fn, 0), 0)) AS DOUBLE) + 0.0::DOUBLE) AS accuracy,
 (CAST(printf('%.4f', coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0)) AS DOUBLE) + 0.0::DOUBLE) AS precision,
 (CAST(printf('%.4f', coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0)) AS DOUBLE) + 0.0::DOUBLE) AS recall,
 (CAST(printf('%.4f', coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0)) AS DOUBLE) + 0.0::DOUBLE) AS f1"""


def conf(groups: str, source: str, t: str = "threshold", extra: str = "") -> str:
    g = f"{groups}, " if groups else ""
    return f"""SELECT *, {DERIVED} FROM (SELECT {g}{extra}CAST(count_if(y = 1 AND p >= {t}) AS BIGINT) AS tp, CAST(count_if(y = 0 AND p >= {t}) AS BIGINT) AS fp,
 CAST(count_if(y = 0 AND p < {t}) AS BIGINT) AS tn, CAST(count_if(y = 1 AND p < {t}) AS BIGINT) AS fn FROM {source} GROUP BY ALL) q"""


SWEEP = conf("model, split", "v_scored, (SELECT CAST(k AS DOUBLE) / 100 AS threshold FROM range(10, 95, 5) r(k))", extra="threshold, ")


def ranking(groups: str, source: str, digits: int = 4) -> str:
    on = " AND ".join(f"w.{g} = z.{g}" for g in groups.split(", "))
    return f"""SELECT {groups}, (CAST(printf('%.{digits}f', CASE WHEN pp > 0 AND nn > 0 AND k > 1 THEN u / (pp * nn) ELSE 0.5::DOUBLE END) AS DOUBLE) + 0.0::DOUBLE) AS roc_auc,
 (CAST(printf('%.{digits}f', CASE WHEN pp > 0 AND nn > 0 AND k > 1 THEN ap / pp ELSE (CAST(printf('%.4f', pp / (pp + nn)) AS DOUBLE) + 0.0::DOUBLE) END) AS DOUBLE) + 0.0::DOUBLE) AS pr_auc FROM (
 SELECT {groups}, CAST(any_value(p_all) AS DOUBLE) AS pp, CAST(any_value(n_all) AS DOUBLE) AS nn, count(*) AS k,
  sum(CAST(pos AS DOUBLE) * (cneg - neg) + CAST(pos AS DOUBLE) * neg / 2) AS u,
  sum(coalesce(CAST(pos AS DOUBLE) * (p_all - cpos + pos) / nullif(p_all - cpos + pos + n_all - cneg + neg, 0), 0)) AS ap FROM (
  SELECT *, sum(pos) OVER (PARTITION BY {groups} ORDER BY p) AS cpos, sum(neg) OVER (PARTITION BY {groups} ORDER BY p) AS cneg,
   sum(pos) OVER (PARTITION BY {groups}) AS p_all, sum(neg) OVER (PARTITION BY {groups}) AS n_all FROM (
   SELECT {groups}, p, count_if(y = 1) AS pos, count_if(y = 0) AS neg FROM {source} GROUP BY ALL) a) b GROUP BY {groups}) d"""


def points(groups: str, rfloor: float, pfloor: float) -> str:
    cols = f"{groups}, threshold, f1, precision, recall, tp, fp, tn, fn"
    return f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY {groups} ORDER BY f1 DESC, threshold) AS by_f1,
  row_number() OVER (PARTITION BY {groups}, recall >= {rfloor} ORDER BY f1 DESC, threshold) AS by_f1_rec, row_number() OVER (PARTITION BY {groups} ORDER BY recall DESC, threshold) AS by_rec, max(recall) OVER (PARTITION BY {groups}) >= {rfloor} AS has_rec,
  row_number() OVER (PARTITION BY {groups}, precision > 0 AND recall > 0 ORDER BY (CAST(printf('%.4f', abs(precision - recall)) AS DOUBLE) + 0.0::DOUBLE), threshold) AS by_gap, max(least(precision, recall)) OVER (PARTITION BY {groups}) > 0 AS has_gap,
  row_number() OVER (PARTITION BY {groups}, precision >= {pfloor} ORDER BY f1 DESC, threshold) AS by_f1_prec, row_number() OVER (PARTITION BY {groups}, tp + fp > 0 ORDER BY precision DESC, threshold) AS by_prec,
  max(precision) OVER (PARTITION BY {groups}) >= {pfloor} AS has_prec, max(tp + fp) OVER (PARTITION BY {groups}) > 0 AS has_pred FROM sweep)
SELECT 'max_f1' AS point, {cols} FROM r WHERE by_f1 = 1
UNION ALL SELECT 'high_recall', {cols} FROM r WHERE CASE WHEN has_rec THEN recall >= {rfloor} AND by_f1_rec = 1 ELSE by_rec = 1 END
UNION ALL SELECT 'balanced', {cols} FROM r WHERE CASE WHEN has_gap THEN precision > 0 AND recall > 0 AND by_gap = 1 ELSE by_f1 = 1 END
UNION ALL SELECT 'high_precision', {cols} FROM r WHERE CASE WHEN has_prec THEN precision >= {pfloor} AND by_f1_prec = 1 WHEN has_pred THEN tp + fp > 0 AND by_prec = 1 ELSE by_f1 = 1 END
UNION ALL SELECT 'production', {cols} FROM r WHERE threshold = 0.35::DOUBLE"""


SIX = {"six": "SELECT model, split, l_partkey % 3 AS part3, y, p FROM v_scored"}
METRICS = f"""SELECT m.*, k.roc_auc, k.pr_auc FROM ({conf('model, split', 'v_scored', '0.35::DOUBLE')}) m JOIN ({ranking('model, split', 'v_scored')}) k ON m.model = k.model AND m.split = k.split"""
SIX_METRICS = f"""SELECT m.*, k.roc_auc, k.pr_auc FROM ({conf('model, split', 'six3', '0.35::DOUBLE')}) m JOIN ({ranking('model, split', 'six3')}) k ON m.model = k.model AND m.split = k.split"""
SIX3 = {"six3": "SELECT concat(model, '_', CAST(l_partkey % 3 AS STRING)) AS model, split, y, p FROM v_scored"}


def six(t):
    """Six models: the two of the table, each cut in three by part."""
    name = F.concat_ws("_", "model", (c("l_partkey") % 3).cast("string"))
    return t.v_scored.select(name.alias("model"), "split", "y", "p")


@query("j12_threshold_sweep", wa(["v_scored"], SWEEP))
def j12(t):
    return ev.threshold_sweep(t.v_scored, G)


@query("a11_confusion", wa(["v_scored"], conf("model, split", "v_scored", "0.35::DOUBLE")))
def a11(t):
    return ev.confusion(t.v_scored, G, 0.35).drop("threshold")


@query("a12_roc_auc", wa(["v_scored"], f"SELECT model, split, roc_auc FROM ({ranking('model, split', 'v_scored', 9)}) q"))
def a12(t):
    out = ev.ranking_metrics(t.v_scored, G, None)
    return out.select(*G, F.round("roc_auc", 9).alias("roc_auc"))


@query("a13_average_precision", wa(["v_scored"], f"SELECT model, split, pr_auc FROM ({ranking('model, split', 'v_scored', 9)}) q"))
def a13(t):
    out = ev.ranking_metrics(t.v_scored, G, None)
    return out.select(*G, F.round("pr_auc", 9).alias("pr_auc"))


@query("a14_brier_score", wa(["v_scored"], "SELECT model, split, (CAST(printf('%.4f', avg((p - y) * (p - y))) AS DOUBLE) + 0.0::DOUBLE) AS brier_score FROM v_scored GROUP BY ALL"))
def a14(t):
    return ev.brier_score(t.v_scored, G)


@query("a15_probability_stats", wa(["v_scored"], "SELECT model, split, (CAST(printf('%.4f', min(p)) AS DOUBLE) + 0.0::DOUBLE) AS min, (CAST(printf('%.4f', max(p)) AS DOUBLE) + 0.0::DOUBLE) AS max, (CAST(printf('%.4f', avg(p)) AS DOUBLE) + 0.0::DOUBLE) AS mean, (CAST(printf('%.4f', median(p)) AS DOUBLE) + 0.0::DOUBLE) AS median FROM v_scored GROUP BY ALL"))
def a15(t):
    return ev.probability_stats(t.v_scored, G)


# Scores of no model are a group of their own: one SQL group per name, the null one under another name.
NAMED = {"named": "SELECT CASE WHEN l_suppkey % 3 = 0 THEN '(none)' ELSE model END AS model, split, y, p FROM v_scored"}
UNNAMED = "SELECT nullif(q.model, '(none)') AS model, q.* EXCLUDE (model) FROM ({}) q"


@query("m8_scores_without_model", wa(["v_scored"], UNNAMED.format(f"SELECT m.*, k.roc_auc, k.pr_auc, b.brier_score, b.median FROM ({conf('model, split', 'named', '0.35::DOUBLE')}) m JOIN ({ranking('model, split', 'named')}) k ON m.model = k.model AND m.split = k.split JOIN (SELECT model, split, (CAST(printf('%.4f', avg((p - y) * (p - y))) AS DOUBLE) + 0.0::DOUBLE) AS brier_score, (CAST(printf('%.4f', median(p)) AS DOUBLE) + 0.0::DOUBLE) AS median FROM named GROUP BY ALL) b ON m.model = b.model AND m.split = b.split"), NAMED))
def m8_unnamed(t):
    rows = t.v_scored.withColumn("model", F.when(c("l_suppkey") % 3 != 0, c("model")))
    medians = ev.probability_stats(rows, G).select(*G, "median")
    return join_groups(ev.detailed_metrics(rows, G, 0.35).drop("threshold"), medians, G)


@query("a16_majority_baseline", wa(["v_scored"], f"""SELECT *, 0.5::DOUBLE AS roc_auc, {DERIVED} FROM (SELECT model, k.majority,
 CAST(count_if(y = 1 AND majority = 1) AS BIGINT) AS tp, CAST(count_if(y = 0 AND majority = 1) AS BIGINT) AS fp, CAST(count_if(y = 0 AND majority = 0) AS BIGINT) AS tn, CAST(count_if(y = 1 AND majority = 0) AS BIGINT) AS fn
 FROM v_scored, (SELECT CASE WHEN count_if(y = 1) > count_if(y = 0) THEN 1 ELSE 0 END AS majority FROM v_scored WHERE split = 'validation') k WHERE split = 'test' GROUP BY ALL) q"""))
def a16(t):
    rows = t.v_scored
    majority = ev.majority_label(rows.where("split = 'validation'"))
    return ev.majority_baseline(rows.where("split = 'test'"), ["model"], majority)


@query("m6_majority_classifier", wa(["v_scored"], "SELECT CASE WHEN count_if(y = 1) > count_if(y = 0) THEN 1 ELSE 0 END AS majority, CAST(count_if(y = 1) AS BIGINT) AS pos FROM v_scored"))
def m6(t):
    rows = t.v_scored
    return rows.agg(F.lit(ev.majority_label(rows)).alias("majority"), F.count_if(c("y") == 1).alias("pos"))


@query("w4_operating_points", wa(["v_scored"], "SELECT * FROM (WITH x AS (SELECT 1)" + points("model, split", 0.7, 0.6) + ") z", {"sweep": SWEEP}))
def w4(t):
    return ev.operating_points(ev.threshold_sweep(t.v_scored, G), G)


@query("w4_selection_points", wa(["v_scored"], "SELECT * FROM (WITH x AS (SELECT 1)" + points("model, split", 0.75, 0.7) + ") z", {**SIX3, "sweep": SWEEP.replace("v_scored", "six3")}))
def w4b(t):
    return ev.operating_points(ev.threshold_sweep(six(t), G), G, ev.SELECTION_FLOORS)


@query("m8_frozen_threshold", wa(["v_scored"], f"SELECT m.*, k.roc_auc, k.pr_auc, b.brier_score FROM ({conf('model, split', 'v_scored', '0.35::DOUBLE')}) m JOIN ({ranking('model, split', 'v_scored')}) k ON m.model = k.model AND m.split = k.split JOIN (SELECT model, split, (CAST(printf('%.4f', avg((p - y) * (p - y))) AS DOUBLE) + 0.0::DOUBLE) AS brier_score FROM v_scored GROUP BY ALL) b ON m.model = b.model AND m.split = b.split"))
def m8(t):
    return ev.detailed_metrics(t.v_scored, G, 0.35).drop("threshold")


@query("m13_model_comparison", wa(["v_scored"], f"SELECT m.*, k.roc_auc, k.pr_auc FROM ({conf('model', 'held', '0.5::DOUBLE')}) m JOIN ({ranking('model', 'held')}) k ON m.model = k.model",
  {**SIX3, "held": "SELECT model, y, p FROM six3 WHERE split = 'test'"}))
def m13(t):
    held = six(t).where("split = 'test'")
    return ev.confusion(held, ["model"], 0.5).drop("threshold").join(ev.ranking_metrics(held, ["model"]), "model")


@query("w5_rank_candidates", wa(["v_scored"], "SELECT substr(model, 1, 7) AS family, model AS cfg_id, pr_auc, roc_auc, f1, row_number() OVER (PARTITION BY substr(model, 1, 7) ORDER BY pr_auc DESC, roc_auc DESC, f1 DESC, model) AS candidate_rank FROM m WHERE split = 'validation'", {**SIX3, "m": SIX_METRICS}))
def w5(t):
    rows = ev.detailed_metrics(six(t), G, 0.35).where("split = 'validation'")
    rows = rows.select(F.substring("model", 1, 7).alias("family"), c("model").alias("cfg_id"), "pr_auc", "roc_auc", "f1")
    return ev.rank_candidates(rows, ["family"])


NAMES = ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"]


@query("p27_metric_deltas", wa(["v_scored"], "SELECT a.model, " + ", ".join(f"(CAST(printf('%.4f', b.{m} - a.{m}) AS DOUBLE) + 0.0::DOUBLE) AS {m}_diff" for m in NAMES) + " FROM m a JOIN m b ON a.model = b.model AND a.split = 'validation' AND b.split = 'test'", {**SIX3, "m": SIX_METRICS}))
def p27(t):
    return ev.metric_deltas(ev.detailed_metrics(six(t), G, 0.35), ["model"], NAMES)


@query("p18_overfit_flag", wa(["v_scored"], "SELECT a.model, a.f1 AS train_f1, b.f1 AS validation_f1, a.f1 - b.f1 > 0.25 AS overfit FROM m a JOIN m b ON a.model = b.model AND a.split = 'test' AND b.split = 'validation'", {**SIX3, "m": SIX_METRICS}))
def p18(t):
    f1 = lambda s: F.max(F.when(c("split") == s, c("f1")))
    wide = ev.confusion(six(t), G, 0.35).groupBy("model").agg(f1("test").alias("train_f1"), f1("validation").alias("validation_f1"))
    return wide.withColumn("overfit", fs.overfit_flag(c("train_f1"), c("validation_f1")))


@query("m12_champion_decision", wa(["v_scored"], """SELECT v.model, v.pr_auc AS validation, w.pr_auc AS test, cv.pr_auc AS champion_validation, cw.pr_auc AS champion_test,
 (CAST(printf('%.4f', v.pr_auc - cv.pr_auc) AS DOUBLE) + 0.0::DOUBLE) AS validation_gain, (CAST(printf('%.4f', v.pr_auc - cv.pr_auc) AS DOUBLE) + 0.0::DOUBLE) >= 0.03 AND w.pr_auc > cw.pr_auc AS is_meaningful,
 CASE WHEN (CAST(printf('%.4f', v.pr_auc - cv.pr_auc) AS DOUBLE) + 0.0::DOUBLE) >= 0.03 AND w.pr_auc > cw.pr_auc THEN 'propose_promotion' ELSE 'keep_champion' END AS decision
 FROM m v JOIN m w ON v.model = w.model AND w.split = 'test' JOIN m cv ON cv.model = 'model_F_0' AND cv.split = 'validation' JOIN m cw ON cw.model = 'model_F_0' AND cw.split = 'test'
 WHERE v.split = 'validation' AND v.model <> 'model_F_0'""", {**SIX3, "m": SIX_METRICS}))
def m12(t):
    return ev.champion_decision(ev.ranking_metrics(six(t), G), "model_F_0")


@query("w11_error_samples", wa(["v_scored"], f"""SELECT model, error_type, sample_no, l_orderkey, p FROM (
 SELECT *, row_number() OVER (PARTITION BY model, error_type ORDER BY p, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS sample_no FROM (SELECT *, {ERR} AS error_type FROM v_scored) a WHERE error_type IN ('FN', 'FP')) b WHERE sample_no <= 3"""))
def w11(t):
    orders = t.orders.select(c("o_orderkey").alias("l_orderkey"), "o_custkey")
    out = ev.error_samples(ev.error_rows(t.v_scored), orders, ["l_orderkey"], ["model"], ["p", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return out.select("model", "error_type", "sample_no", "l_orderkey", "p")


@query("j10_errors_with_features", wa(["v_scored", "v_commits", "v_changes", "v_hunks"], f"""SELECT s.l_orderkey, s.l_linenumber, s.l_partkey, s.l_suppkey, s.error_type, f.code_churn, f.files_changed, f.functions_changed
 FROM (SELECT *, {ERR} AS error_type FROM v_scored) s JOIN feat f ON f.seq = s.l_orderkey WHERE s.error_type IN ('FN', 'FP')""", qf.P_FEAT))
def j10(t):
    errors = ev.error_rows(t.v_scored).where(c("error_type").isin("FN", "FP"))
    feats = qf.features(t).select(c("seq").alias("l_orderkey"), "code_churn", "files_changed", "functions_changed")
    return errors.join(feats, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "error_type", "code_churn", "files_changed", "functions_changed")


@query("u1_union_sweeps", wa(["v_scored"], "SELECT model, threshold, tp, fp, tn, fn FROM (" + SWEEP + ") a UNION ALL SELECT 'all' AS model, threshold, CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(tn) AS BIGINT), CAST(sum(fn) AS BIGINT) FROM (" + SWEEP + ") b GROUP BY threshold"))
def u1(t):
    cols = ["model", "threshold", "tp", "fp", "tn", "fn"]
    single = ev.threshold_sweep(t.v_scored, G).select(*cols)
    pooled = ev.threshold_sweep(t.v_scored, []).withColumn("model", F.lit("all")).select(*cols)
    return single.unionByName(pooled)


def _comparison(t):
    metrics = ev.detailed_metrics(six(t), G, 0.35).where("split = 'validation'").select("model", "roc_auc", "pr_auc", "f1")
    anchor = metrics.where("model = 'model_F_0'").drop("f1")
    rest = metrics.where("model <> 'model_F_0'")
    best = rest.agg(F.max_by("model", F.struct("pr_auc", "roc_auc", "f1")).alias("m")).first()["m"]
    return ev.comparison_table(anchor, rest, c("model") == best)


COMPARE = """SELECT model, roc_auc, pr_auc, CASE WHEN model = 'model_F_0' THEN NULL ELSE f1 END AS f1, model = 'model_F_0' AS is_production,
 model = (SELECT model FROM m WHERE split = 'validation' AND model <> 'model_F_0' ORDER BY pr_auc DESC, roc_auc DESC, f1 DESC LIMIT 1) AS is_winner FROM m WHERE split = 'validation'"""


@query("u2_comparison_table", wa(["v_scored"], COMPARE, {**SIX3, "m": SIX_METRICS}))
def u2(t):
    return _comparison(t)


@query("u4_tidy_metrics", wa(["v_scored"], " UNION ALL ".join(f"SELECT model, '{m}' AS metric, {m} AS value FROM cmp WHERE {m} IS NOT NULL" for m in ("roc_auc", "pr_auc", "f1")), {**SIX3, "m": SIX_METRICS, "cmp": COMPARE}))
def u4(t):
    return ev.tidy_metrics(_comparison(t), ["model"], ["roc_auc", "pr_auc", "f1"])


@query("s8_markdown_summary", wa(["v_scored"], "SELECT model, concat('| ', concat_ws(' | ', model, printf('%.4f', pr_auc), printf('%.4f', roc_auc), coalesce(printf('%.4f', f1), 'n/a'), CASE WHEN is_winner THEN 'yes' ELSE 'no' END), ' |') AS markdown FROM cmp", {**SIX3, "m": SIX_METRICS, "cmp": COMPARE}))
def s8(t):
    return ev.markdown_summary(_comparison(t))


@query("u3_hash_sets", wa(["v_commits", "v_hunks"], """SELECT 'both' AS part, count(*) AS n FROM (SELECT full_hash FROM v_commits INTERSECT SELECT full_hash FROM v_hunks) a
 UNION ALL SELECT 'left_only', count(*) FROM (SELECT full_hash FROM v_commits EXCEPT SELECT full_hash FROM v_hunks) b"""))
def u3(t):
    a, b = t.v_commits.select("full_hash"), t.v_hunks.select("full_hash").distinct()
    count = lambda d, n: d.agg(F.count("*").alias("n")).select(F.lit(n).alias("part"), "n")
    return count(a.intersect(b), "both").unionByName(count(a.exceptAll(b), "left_only"))


# --- scoring with fixed coefficients ---------------------------------------------------------
COEF = [0.8, -0.3, 0.5, 0.4, 0.2, 0.3, -0.6, 0.1, 0.25, -0.15]
BIAS = -0.4
SCALE = {f: (float(3 + i), float(2 + i)) for i, f in enumerate(FEATURES)}
ZS = {f: f"((CAST({f} AS DOUBLE) - {SCALE[f][0]}::DOUBLE) / {SCALE[f][1]}::DOUBLE)" for f in FEATURES}
LOGIT = f"{BIAS}::DOUBLE + " + " + ".join(f"{ZS[f]} * {b}::DOUBLE" for f, b in zip(FEATURES, COEF, strict=True))
SCORED = f"SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-({LOGIT}))) AS p FROM feat"
CONTRIB = " UNION ALL ".join(f"SELECT repo, full_hash, {i} AS i, '{f}' AS feature, {ZS[f]} * {b}::DOUBLE AS v FROM feat" for i, (f, b) in enumerate(zip(FEATURES, COEF, strict=True)))
P_SCORED = {**qf.P_FEAT, "scored": SCORED}
P_CON = {**qf.P_FEAT, "contrib": CONTRIB}
V_FEAT = ["v_commits", "v_changes", "v_hunks"]


def scored(t):
    return md.score_logistic(qf.features(t), COEF, BIAS, SCALE)


@query("m9_batch_scoring", wa(V_FEAT, """SELECT repo, full_hash, round(p, 4) AS raw_probability, p >= 0.35::DOUBLE AS is_above_threshold, CASE WHEN p >= 0.35::DOUBLE THEN 'Elevated Defect Risk' ELSE 'Standard Risk Change' END AS prediction_label,
 CASE WHEN p < 0.35::DOUBLE THEN 'LOW' WHEN p < 0.6::DOUBLE THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level FROM scored""", P_SCORED))
def m9(t):
    return scored(t).select("repo", "full_hash", "raw_probability", "is_above_threshold", "prediction_label", "risk_level")


def _factor_sql(where: str, order: str) -> str:
    return f"SELECT repo, full_hash, coalesce(string_agg(concat(feature, '=', printf('%.4f', CAST(printf('%.4f', v) AS DOUBLE) + 0.0::DOUBLE)), ',' ORDER BY {order}) FILTER ({where}), '') AS factors FROM contrib GROUP BY repo, full_hash"


@query("m10_contributions", wa(V_FEAT, _factor_sql("true", "i"), P_CON))
def m10(t):
    return scored(t).select("repo", "full_hash", fs.factors_text(c("contributions")).alias("factors"))


@query("w6_top_positive", wa(V_FEAT, _factor_sql("v > 0", "v DESC, i"), P_CON))
def w6(t):
    return scored(t).select("repo", "full_hash", fs.factors_text(c("top_positive")).alias("factors"))


@query("w6_top_negative", wa(V_FEAT, _factor_sql("v < 0", "v, i"), P_CON))
def w6n(t):
    return scored(t).select("repo", "full_hash", fs.factors_text(c("top_negative")).alias("factors"))


@query("w7_by_magnitude", wa(V_FEAT, _factor_sql("true", "abs(v) DESC, i"), P_CON))
def w7(t):
    z = st.standardize(qf.features(t), SCALE)
    factors = fs.contributions([c(f"{f}_z") for f in FEATURES], COEF, FEATURES)
    ranked = fs.rounded_factors(fs.by_magnitude(factors))
    return z.select("repo", "full_hash", fs.factors_text(ranked).alias("factors"))


@query("m15_fingerprint", wa(["v_commits"], f"SELECT repo, full_hash, sha256('{md.fingerprint(COEF, BIAS, {k: list(v) for k, v in SCALE.items()})}') AS score_fingerprint FROM v_commits"))
def m15(t):
    return scored(t).select("repo", "full_hash", "score_fingerprint")


@query("u5_explain_features", wa(V_FEAT, " UNION ALL ".join(
    f"SELECT repo, full_hash, {i + 1} AS ordinal, '{f}' AS feature, {'NULL' if f == 'lines_deleted' else f'CAST({f} AS DOUBLE)'} AS value, true AS is_canonical FROM feat" for i, f in enumerate(FEATURES))
    + " UNION ALL SELECT repo, full_hash, 11, 'extra_a', CAST(seq AS DOUBLE), false FROM feat", qf.P_FEAT))
def u5(t):
    names = [f for f in FEATURES if f != "lines_deleted"]
    m = F.map_from_arrays(F.array(F.lit("extra_a"), *[F.lit(f) for f in names]), F.array(c("seq").cast("double"), *[c(f).cast("double") for f in names]))
    return md.explain_features(qf.features(t).withColumn("m", m), ["repo", "full_hash"], "m")


@query("n8_result_json", wa(V_FEAT, """SELECT repo, full_hash, full_hash AS hash, CAST(printf('%.4f', p) AS DOUBLE) AS raw_probability, CASE WHEN p < 0.35::DOUBLE THEN 'LOW' WHEN p < 0.6::DOUBLE THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level,
 CAST(lines_added AS DOUBLE) AS lines_added, 10 AS contributions FROM scored""", P_SCORED))
def n8(t):
    """Fields read back from the nested result document of each commit."""
    field = lambda path: F.get_json_object("json", f"$.{path}")
    return md.result_struct(scored(t)).select(
        "repo", "full_hash", field("full_hash").alias("hash"), field("raw_probability").cast("double").alias("raw_probability"),
        field("risk_level").alias("risk_level"), field("features.lines_added").cast("double").alias("lines_added"),
        F.json_array_length(field("model_signals.log_odds_contributions")).alias("contributions"),
    )


# --- Spark ML (values depend on the optimiser; rows only) -------------------------------------
def _ml_splits(t):
    """Stored once: the fits below read the rows many times."""
    return materialize(qf.splits(t))


def _scaled(parts):
    return st.standardize(parts, st.scaler_values(parts.where("split = 'train'")))


def _checked(metrics):
    """What any fit must give: the rows and positives of the split, and metrics that fit together."""
    total = c("tp") + c("fp") + c("tn") + c("fn")
    inside = lambda x: c(x).between(0, 1)
    fits = (
        (F.abs(c("accuracy") - (c("tp") + c("tn")) / total) <= 0.00005)
        & (F.abs(c("predicted_positive_rate") - (c("tp") + c("fp")) / total) <= 0.00005)
        & inside("roc_auc") & inside("pr_auc") & inside("brier_score")
        & (c("roc_auc") > 0.5)
    )
    return metrics.select(*[x for x in ("model", "split") if x in metrics.columns], total.alias("rows"), (c("tp") + c("fn")).alias("positives"), fits.alias("metrics_fit"))


def _evaluate(model, parts, name):
    rows = md.positive_score(model, parts.where("split <> 'train'"), ["split"])
    out = ev.detailed_metrics(rows, ["split"], 0.35)
    return _checked(out.withColumn("model", F.lit(name)))


def _fit_oracle(name):
    return wa(qf.V_ALL, f"""SELECT '{name}' AS model, split, count(*) AS rows, CAST(sum(bug_introduced) AS BIGINT) AS positives, true AS metrics_fit
 FROM splits WHERE split <> 'train' GROUP BY split""", qf.P_SPLIT)


@query("m1_assemble", wa(V_FEAT, f"SELECT repo, full_hash, 10 AS n, CAST(lines_added AS DOUBLE) AS lines_added, CAST({' + '.join(FEATURES)} AS DOUBLE) AS total FROM feat", qf.P_FEAT))
def m1(t):
    """Length, first value and sum of the assembled vector of every commit."""
    from pyspark.ml.functions import vector_to_array

    out = md.assemble(qf.features(t))
    v = vector_to_array("features")
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return out.select("repo", "full_hash", F.size(v).alias("n"), v[0].alias("lines_added"), total.alias("total"))


@query("m3_logistic", _fit_oracle("logistic"))
def m3(t):
    parts = _scaled(_ml_splits(t))
    train = parts.where("split = 'train'")
    return _evaluate(md.logistic(train.count()).fit(train), parts, "logistic")


@query("m4_forest", _fit_oracle("forest"))
def m4(t):
    parts = _ml_splits(t)
    return _evaluate(md.forest(**md.FOREST_GRID[1]).fit(parts.where("split = 'train'")), parts, "forest")


@query("m5_boosted", _fit_oracle("boosted"))
def m5(t):
    parts = _ml_splits(t)
    return _evaluate(md.boosted(**md.BOOSTED_GRID[0]).fit(parts.where("split = 'train'")), parts, "boosted")


@query("m7_grid_search")
def m7(t):
    """Ranked logistic configurations with their best threshold (rows only)."""
    return md.grid_search(_scaled(_ml_splits(t)), "logistic", md.LOGISTIC_GRID, ["full_hash"])[0]


@query("m11_model_weights", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{f}', 'coefficient', true)" for i, f in enumerate(FEATURES, start=1)) + ") v(ordinal, feature, kind, finite)")
def m11(t):
    parts = _scaled(_ml_splits(t))
    train = parts.where("split = 'train'")
    weights = md.model_weights(md.logistic(train.count()).fit(train), FEATURES, t.spark)
    return weights.select("ordinal", "feature", "kind", (~F.isnan("weight") & (F.abs("weight") < 1e6)).alias("finite"))


@query("m14_ablation", wa(qf.V_ALL, """SELECT m.model, count(*) AS rows, CAST(sum(bug_introduced) AS BIGINT) AS positives, true AS metrics_fit
 FROM splits, (VALUES ('subset'), ('full')) m(model) WHERE split = 'test' GROUP BY m.model""", qf.P_SPLIT))
def m14(t):
    return _checked(md.ablation(_ml_splits(t), FEATURES[:5], ["full_hash"]))
