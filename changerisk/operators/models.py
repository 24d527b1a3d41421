"""Training, persistence and scoring with Spark ML."""

from __future__ import annotations

import json
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from changerisk.functions import scoring as fs
from changerisk.functions.rounding import round_exact
from changerisk.operators import evaluation as ev
from changerisk.operators.stats import scaler_values, standardize
from changerisk.schema import FEATURES, PRODUCTION_THRESHOLD, TARGET
from changerisk.session import materialize

SEED = 42
# The three search grids.
LOGISTIC_GRID = [{"C": 0.01}, {"C": 0.1}, {"C": 1.0}, {"C": 10.0}]
FOREST_GRID = [
    {"trees": 100, "depth": 3, "min_split": 5},
    {"trees": 100, "depth": 5, "min_split": 5},
    {"trees": 100, "depth": 8, "min_split": 5},
    {"trees": 200, "depth": 5, "min_split": 5},
    {"trees": 200, "depth": None, "min_split": 10},
]
BOOSTED_GRID = [
    {"rounds": 100, "depth": 3, "rate": 0.05},
    {"rounds": 100, "depth": 4, "rate": 0.05},
    {"rounds": 100, "depth": 6, "rate": 0.01},
    {"rounds": 200, "depth": 3, "rate": 0.05},
    {"rounds": 200, "depth": 4, "rate": 0.10},
]
GRIDS = {"logistic": LOGISTIC_GRID, "forest": FOREST_GRID, "boosted": BOOSTED_GRID}
SIDE_BY_SIDE = 4  # fits at a time
MAX_DEPTH = 30  # the deepest tree Spark ML grows
PROVENANCE = {
    "model_id": "logistic_regression",
    "model_version": "1.0.0",
    "feature_schema_version": "10-features",
}


def assemble(df: DataFrame, columns: list[str] | None = None, out: str = "features") -> DataFrame:
    """Feature vector in canonical order; a missing column or a null value is an error."""
    names = columns or FEATURES
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"feature columns missing: {missing}")
    return VectorAssembler(inputCols=names, outputCol=out, handleInvalid="error").transform(df)


def logistic(n_train: int, C: float = 1.0, max_iter: int = 1000, columns: list[str] | None = None):
    """L2 logistic regression on scaled columns; ``C`` is turned into a per-row penalty."""
    names = columns or [f"{f}_z" for f in FEATURES]
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=names, outputCol="features", handleInvalid="error"),
            LogisticRegression(
                labelCol=TARGET,
                maxIter=max_iter,
                regParam=1.0 / (C * max(n_train, 1)),
                elasticNetParam=0.0,
                standardization=False,
            ),
        ]
    )


def forest(trees: int = 100, depth: int | None = None, min_split: int = 2) -> Pipeline:
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="error"),
            RandomForestClassifier(
                labelCol=TARGET,
                numTrees=trees,
                maxDepth=MAX_DEPTH if depth is None else depth,
                minInstancesPerNode=max(1, min_split // 2),
                seed=SEED,
            ),
        ]
    )


def boosted(rounds: int = 100, depth: int = 6, rate: float = 0.3) -> Pipeline:
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="error"),
            GBTClassifier(labelCol=TARGET, maxIter=rounds, maxDepth=depth, stepSize=rate, seed=SEED),
        ]
    )


def positive_score(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """Scored rows: the kept columns, ``y`` and the probability ``p`` of class 1."""
    scored = model.transform(df)
    return scored.select(
        *keep, F.col(TARGET).alias("y"), vector_to_array("probability")[1].alias("p")
    )


def fit_grid(splits: DataFrame, grids: dict[str, list[dict]], side_by_side: int = SIDE_BY_SIDE) -> dict[str, tuple[str, PipelineModel]]:
    """Family and model of each configuration, by ``cfg_id``, fitted on train.

    Fits run from several driver threads, so that the small last steps of one fit do not leave
    the cluster idle; each of them is a Spark job over the stored splits.
    """
    train = splits.where(F.col("split") == "train")
    n_train = train.count()
    make = {"logistic": lambda **how: logistic(n_train, **how), "forest": forest, "boosted": boosted}
    names = [(family, f"{family}_cfg_{i}", how) for family, grid in grids.items() for i, how in enumerate(grid, start=1)]
    work = inheritable_thread_target(splits.sparkSession)(lambda x: make[x[0]](**x[2]).fit(train))
    with ThreadPool(max(1, min(side_by_side, len(names)))) as pool:
        fitted = pool.map(work, names, chunksize=1)
    return {cfg: (family, model) for (family, cfg, _), model in zip(names, fitted, strict=True)}


def _judged(splits: DataFrame, fitted: dict[str, tuple[str, PipelineModel]], keep: list[str]) -> DataFrame:
    """One row per configuration: its best point on validation and its ranking metrics."""
    rows = splits.where(F.col("split") == "validation")
    parts = [
        positive_score(model, rows, keep).select(F.lit(family).alias("family"), F.lit(cfg).alias("cfg_id"), "y", "p")
        for cfg, (family, model) in fitted.items()
    ]
    groups = ["family", "cfg_id"]
    scored = materialize(reduce(DataFrame.unionByName, parts))
    points = ev.operating_points(ev.threshold_sweep(scored, groups), groups).where(F.col("point") == "max_f1")
    return points.join(ev.ranking_metrics(scored, groups), groups)


def grid_search(splits: DataFrame, family: str, grid: list[dict], keep: list[str]) -> tuple[DataFrame, dict]:
    """Fit each configuration on train and score validation; all are judged in one aggregation.

    Returns the ranked candidates (PR-AUC, ROC-AUC, F1 at the best threshold) and the models by
    ``cfg_id``. The splits are expected to be stored or checkpointed by the caller.
    """
    fitted = fit_grid(splits, {family: grid})
    candidates = _judged(splits, fitted, keep)
    columns = ["cfg_id", *[c for c in candidates.columns if c not in ("cfg_id", "family")], "family"]
    return ev.rank_candidates(candidates.select(*columns), ["family"]), {cfg: m for cfg, (_, m) in fitted.items()}


def family_search(
    splits: DataFrame, keep: list[str], grids: dict[str, list[dict]] | None = None, side_by_side: int = SIDE_BY_SIDE
) -> tuple[DataFrame, DataFrame, PipelineModel]:
    """Search all families: the ranked configurations, the winner's test metrics, and its model.

    ``splits`` holds the features and their scaled columns, stored by the caller. Configurations
    are ranked inside their family (candidate_rank) and over all (overall_rank) on validation.
    The best one keeps the threshold that it had there, and is judged with it once on test; ties
    go to the family and then the configuration listed first.
    """
    grids = GRIDS if grids is None else grids
    fitted = fit_grid(splits, grids, side_by_side)
    ranked = ev.rank_candidates(_judged(splits, fitted, keep), ["family"])
    place = {cfg: i for i, cfg in enumerate(fitted)}
    listed = F.element_at(F.create_map(*[F.lit(x) for pair in place.items() for x in pair]), F.col("cfg_id"))
    overall = ev.rank_candidates(
        ranked.withColumns({"_in_family": F.col("candidate_rank"), "_listed": listed}), [], "_listed"
    ).withColumnsRenamed({"candidate_rank": "overall_rank"}).withColumnsRenamed({"_in_family": "candidate_rank"})
    overall = materialize(overall.drop("_listed"))
    best = overall.where("overall_rank = 1").select("cfg_id", "threshold").first()
    family, model = fitted[best.cfg_id]
    test = positive_score(model, splits.where(F.col("split") == "test"), keep)
    named = test.select(F.lit(family).alias("family"), F.lit(best.cfg_id).alias("cfg_id"), "y", "p")
    return overall, ev.detailed_metrics(named, ["family", "cfg_id"], best.threshold), model


def save_model(model: PipelineModel, path: str, production: bool = False) -> None:
    """Persist a model; a production artefact is never overwritten."""
    writer = model.write() if production else model.write().overwrite()
    writer.save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_weights(model: Model, names: list[str], spark: SparkSession) -> DataFrame:
    """Coefficients or importances of a fitted model, one row per feature."""
    stage = model.stages[-1] if isinstance(model, PipelineModel) else model
    if hasattr(stage, "coefficients"):
        kind, values = "coefficient", stage.coefficients.toArray()
    else:
        kind, values = "importance", stage.featureImportances.toArray()
    rows = [(i + 1, n, kind, float(v)) for i, (n, v) in enumerate(zip(names, values, strict=True))]
    return spark.createDataFrame(rows, "ordinal int, feature string, kind string, weight double")


def fingerprint(coefficients: list[float], intercept: float, scaler: dict) -> str:
    """Canonical text of what decides a score; its SHA-256 goes with every prediction."""
    return json.dumps(
        {"coefficients": coefficients, "intercept": intercept, "scaler": scaler}, sort_keys=True
    )


def score_logistic(
    features: DataFrame,
    coefficients: list[float],
    intercept: float,
    scaler: dict[str, tuple[float, float]],
    threshold: float = PRODUCTION_THRESHOLD,
) -> DataFrame:
    """Batch scoring with explanations, as column expressions only.

    The decision and the level use the unrounded probability; what is shown is rounded to four
    decimals. Rows with unusable features get ``skip_reason`` and no score.
    """
    z = [F.col(f"{f}_z") for f in FEATURES]
    scaled = standardize(features, scaler)
    logit = F.lit(float(intercept))
    for c, b in zip(z, coefficients, strict=True):
        logit = logit + c * F.lit(float(b))
    finite = fs.is_finite_vector([F.col(f) for f in FEATURES])
    p = F.when(finite, F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)))
    factors = fs.contributions(z, coefficients, FEATURES)
    stamp = fingerprint(coefficients, intercept, {k: list(v) for k, v in scaler.items()})
    above = fs.is_above(F.col("_p"), threshold)
    return (
        scaled.withColumn("_p", p)
        .withColumns(
            {
                "raw_probability": round_exact(F.col("_p"), 4),
                "is_above_threshold": above,
                "decision_threshold": F.lit(float(threshold)),
                "prediction_label": F.when(F.col("_p").isNotNull(), fs.decision_label(above)),
                "risk_level": F.when(F.col("_p").isNotNull(), fs.risk_level(F.col("_p"))),
                "contributions": factors,
                "score_fingerprint": F.sha2(F.lit(stamp), 256),
                "invalid_features": ~finite,
                **{k: F.lit(v) for k, v in PROVENANCE.items()},
            }
        )
        .withColumns(
            {
                "top_positive": fs.rounded_factors(fs.top_positive(F.col("contributions"))),
                "top_negative": fs.rounded_factors(fs.top_negative(F.col("contributions"))),
                "contributions": fs.rounded_factors(F.col("contributions")),
            }
        )
        .drop("_p", *[f"{f}_z" for f in FEATURES])
    )


def result_struct(scored: DataFrame) -> DataFrame:
    """Nested prediction document of each row, and its JSON text."""
    features = F.map_from_arrays(
        F.array(*[F.lit(f) for f in FEATURES]), F.array(*[F.col(f).cast("double") for f in FEATURES])
    )
    nested = F.struct(
        "full_hash",
        "commit_hash",
        "repo",
        "raw_probability",
        "is_above_threshold",
        "decision_threshold",
        "prediction_label",
        "risk_level",
        features.alias("features"),
        F.struct(
            F.col("top_positive").alias("top_positive_factors"),
            F.col("top_negative").alias("top_negative_factors"),
            F.col("contributions").alias("log_odds_contributions"),
        ).alias("model_signals"),
        *PROVENANCE,
        "score_fingerprint",
    )
    return scored.select("repo", "full_hash", nested.alias("result")).withColumn(
        "json", F.to_json("result")
    )


def explain_features(df: DataFrame, ids: list[str], column: str = "features") -> DataFrame:
    """Feature map as rows: canonical features first (null when missing), then the extras."""
    canonical = F.array(*[F.lit(f) for f in FEATURES])
    first = F.transform(
        canonical,
        lambda f, i: F.struct(
            (i + 1).alias("ordinal"), f.alias("feature"), F.try_element_at(column, f).alias("value"),
            F.lit(True).alias("is_canonical"),
        ),
    )
    extras = F.array_sort(F.array_except(F.map_keys(column), canonical))
    rest = F.transform(
        extras,
        lambda f, i: F.struct(
            (i + 1 + len(FEATURES)).alias("ordinal"), f.alias("feature"),
            F.try_element_at(column, f).alias("value"), F.lit(False).alias("is_canonical"),
        ),
    )
    return df.select(*ids, F.inline(F.concat(first, rest)))


def ablation(splits: DataFrame, subset: list[str], keep: list[str]) -> DataFrame:
    """Logistic regression on a feature subset against all features, same split, at 0.5."""
    train = splits.where(F.col("split") == "train")
    n_train = train.count()
    scaled = standardize(splits, scaler_values(train))
    out = None
    for name, cols in (("subset", subset), ("full", FEATURES)):
        names = [f"{c}_z" for c in cols]
        model = logistic(n_train, columns=names).fit(scaled.where(F.col("split") == "train"))
        part = positive_score(model, scaled.where(F.col("split") == "test"), keep)
        part = part.withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return ev.detailed_metrics(out, ["model"], 0.5)
