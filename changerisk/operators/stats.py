"""Descriptive statistics, correlation and train-only scaling."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from changerisk.functions.rounding import round_exact
from changerisk.operators.ordered import exact_medians, join_groups, running_totals
from changerisk.schema import FEATURES
from changerisk.session import materialize

STRONG = 0.70


def unpivot_features(df: DataFrame, ids: list[str], features: list[str] | None = None) -> DataFrame:
    """One row per (id, feature) with the value as a double."""
    names = features or FEATURES
    doubles = df.select(*ids, *[F.col(f).cast("double").alias(f) for f in names])
    return doubles.unpivot(ids, names, "feature", "value")


def per_feature(
    df: DataFrame,
    groups: list[str],
    stats: dict,
    features: list[str] | None = None,
    rounded: tuple[str, ...] = (),
) -> DataFrame:
    """One row per group and feature. All statistics are taken in one wide aggregation and only
    its few result rows are turned long, so the input is never multiplied. The ``rounded`` ones
    get four decimals."""
    cells = [
        F.struct(
            F.lit(f).alias("feature"),
            *[fn(F.col(f).cast("double")).alias(name) for name, fn in stats.items()],
        )
        for f in (features or FEATURES)
    ]
    wide = df.groupBy(*groups).agg(F.array(*cells).alias("_cells"))
    long = wide.select(*groups, F.inline("_cells"))
    return long.withColumns({name: round_exact(F.col(name), 4) for name in rounded})


def descriptive_stats(df: DataFrame, groups: list[str]) -> DataFrame:
    """Min, max, mean, median and sample standard deviation per group and feature (4 decimals)."""
    keys = [*groups, "feature"]
    stats = {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_samp}
    fixed = materialize(df.select(*groups, *[F.col(f).cast("double").alias(f) for f in FEATURES]))
    basic = per_feature(fixed, groups, stats, rounded=("mean", "std"))
    medians = feature_medians(fixed, groups).withColumn("median", round_exact(F.col("median"), 4))
    return join_groups(basic, medians, keys, "left")


#: Shares of the rows between which a median is looked for, and the accuracy of the sketch that
#: finds the values at them: its error is a hundredth of their distance from the middle.
BRACKET, SKETCH = (0.49, 0.51), 10_000


def feature_medians(df: DataFrame, groups: list[str], features: list[str] | None = None) -> DataFrame:
    """Exact median per group and feature: groups, feature, median. Nulls are no values.

    Quantile sketches of all features, made in one pass, give two values around each median. What
    lies below is only counted; the few values between are ranked by running totals. A median
    that its two values do not hold, if a sketch is worse than it should be, is found from all
    values of its group. ``df`` is read three times.
    """
    names, keys = features or FEATURES, [*groups, "feature"]
    doubles = df.select(*groups, *[F.col(f).cast("double").alias(f) for f in names])
    ends = lambda f: F.percentile_approx(f, list(BRACKET), SKETCH)
    brackets = materialize(doubles.groupBy(*groups).agg(*[ends(f).alias(f"_b_{f}") for f in names]))
    # Without groups the brackets are one row.
    beside = join_groups(doubles, brackets, groups)
    low, high = (lambda f: F.col(f"_b_{f}")[0]), (lambda f: F.col(f"_b_{f}")[1])
    inside = [
        F.when(F.col(f).between(low(f), high(f)), F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")))
        for f in names
    ]
    between = beside.select(*groups, F.inline(F.array_compact(F.array(*inside))))
    counted = between.groupBy(*keys, "value").agg(F.count("*").alias("n"))
    ranked = running_totals(counted, keys, ["value"], {"upto": "n"})
    counts = [
        F.struct(F.lit(f).alias("feature"), F.count_if(F.col(f) < low(f)).alias("below"), F.count(f).alias("total"))
        for f in names
    ]
    sizes = materialize(
        beside.groupBy(*groups).agg(F.array(*counts).alias("_c")).select(*groups, F.inline("_c")).where("total > 0")
    )
    upto = F.col("upto") + F.col("below")
    start = upto - F.col("n")
    middle = [F.expr("(total + 1) div 2"), F.expr("(total + 2) div 2")]
    weight = sum(((start < m) & (m <= upto)).cast("int") for m in middle)
    found = materialize(
        join_groups(sizes, ranked, keys, "left")
        .groupBy(*keys)
        .agg((F.sum(weight * F.col("value")) / 2.0).alias("median"), F.sum(weight).alias("_weight"))
    )
    missed = F.coalesce(F.col("_weight"), F.lit(0)) != 2
    medians = found.where(~missed).drop("_weight")
    rest = found.where(missed).select(*keys)
    if rest.isEmpty():
        return medians
    again = join_groups(unpivot_features(doubles, groups, names), rest, keys, "left_semi")
    return medians.unionByName(exact_medians(again, keys, "value"))


def fit_scaler(train: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Mean and population deviation per feature; a constant feature gets scale 1."""
    return per_feature(
        train,
        [],
        {
            "mean": F.avg,
            "scale": lambda c: F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c)),
        },
        features,
    )


def scaler_values(train: DataFrame, features: list[str] | None = None) -> dict[str, tuple[float, float]]:
    """The fitted scaler as driver-side numbers: two per feature, whatever the data size."""
    return {r["feature"]: (r["mean"], r["scale"]) for r in fit_scaler(train, features).collect()}


def standardize(df: DataFrame, scaler: dict[str, tuple[float, float]], suffix: str = "_z") -> DataFrame:
    """Add scaled copies of the features; raw columns stay as they are."""
    return df.withColumns(
        {
            f"{f}{suffix}": (F.col(f).cast("double") - F.lit(mean)) / F.lit(scale)
            for f, (mean, scale) in scaler.items()
        }
    )


def scaled_stats(scaled: DataFrame, groups: list[str], suffix: str = "_z") -> DataFrame:
    """Mean, population deviation, min and max of the scaled columns (4 decimals)."""
    stats = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    return per_feature(scaled, groups, stats, [f"{f}{suffix}" for f in FEATURES], tuple(stats))


def correlation_matrix(train: DataFrame) -> DataFrame:
    """Pearson correlation of every feature pair i < j: one pass, 45 aggregates."""
    pairs = list(combinations(FEATURES, 2))
    wide = train.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = wide.unpivot([], [f"`{c}`" for c in wide.columns], "pair", "r")
    return long.select(
        F.split("pair", r"\|")[0].alias("feature_1"),
        F.split("pair", r"\|")[1].alias("feature_2"),
        round_exact(F.col("r"), 4).alias("correlation"),
        "r",
    )


def strong_pairs(train: DataFrame, threshold: float = STRONG) -> DataFrame:
    return correlation_matrix(train).where(F.abs("r") >= threshold).drop("r")
