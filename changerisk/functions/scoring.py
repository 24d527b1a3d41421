"""Expressions over risk scores and feature contributions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from changerisk.functions.rounding import round_exact

# Presentation bands and labels.
RISK_BANDS = (0.35, 0.60)
LEGACY_BANDS = (0.33, 0.66)
LABEL_ABOVE = "Elevated Defect Risk"
LABEL_BELOW = "Standard Risk Change"
OVERFIT_GAP = 0.25


def risk_level(p: Column, bands: tuple[float, float] = RISK_BANDS) -> Column:
    return F.when(p < bands[0], "LOW").when(p < bands[1], "MEDIUM").otherwise("HIGH")


def legacy_label(p: Column, cut: float = 0.5) -> Column:
    return F.when(p >= cut, "Bug-prone").otherwise("Clean")


def is_above(p: Column, threshold: Column | float) -> Column:
    return p >= threshold


def decision_label(above: Column) -> Column:
    return F.when(above, LABEL_ABOVE).otherwise(LABEL_BELOW)


def error_type(actual: Column, predicted: Column) -> Column:
    """Cell of the confusion matrix."""
    hit = actual == predicted
    return (
        F.when(hit & (actual == 1), "TP")
        .when(hit, "TN")
        .when(predicted == 1, "FP")
        .otherwise("FN")
    )


def overfit_flag(train_f1: Column, validation_f1: Column) -> Column:
    return (train_f1 - validation_f1) > OVERFIT_GAP


def is_finite_vector(columns: list[Column]) -> Column:
    """True when no value is null, NaN or infinite."""
    bad = F.lit(False)
    for c in columns:
        d = c.cast("double")
        bad = bad | d.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf")))
    return ~bad


def signal_direction(value: Column) -> dict[str, Column]:
    """Direction, impact text and magnitude of one contribution."""
    return {
        "abs_contribution": F.abs(value),
        "direction": F.when(value > 0, "Positive").when(value < 0, "Negative").otherwise("Neutral"),
        "impact": F.when(value > 0, "Increases Risk")
        .when(value < 0, "Decreases Risk")
        .otherwise("Neutral"),
    }


def contributions(z: list[Column], coefficients: list[float], names: list[str]) -> Column:
    """Array of (feature, contribution) structs in canonical order; intercept excluded."""
    return F.array(
        *[
            F.struct(F.lit(n).alias("feature"), (c * F.lit(float(b))).alias("contribution"))
            for n, c, b in zip(names, z, coefficients, strict=True)
        ]
    )


def _sorted_factors(factors: Column, key) -> Column:
    """Stable order by ``key``, smallest first; position breaks ties."""
    keyed = F.transform(
        factors,
        lambda x, i: F.struct(
            key(x).alias("k"), i.alias("i"), x["feature"].alias("feature"),
            x["contribution"].alias("contribution"),
        ),
    )
    return F.transform(
        F.array_sort(keyed),
        lambda x: F.struct(
            x["feature"].alias("feature"),
            x["contribution"].alias("contribution"),
        ),
    )


def rounded_factors(factors: Column, digits: int = 4) -> Column:
    return F.transform(
        factors,
        lambda x: F.struct(
            x["feature"].alias("feature"),
            round_exact(x["contribution"], digits).alias("contribution"),
        ),
    )


def top_positive(factors: Column) -> Column:
    """Contributions above zero, largest first."""
    kept = F.filter(factors, lambda x: x["contribution"] > 0)
    return _sorted_factors(kept, lambda x: -x["contribution"])


def top_negative(factors: Column) -> Column:
    """Contributions below zero, most negative first."""
    kept = F.filter(factors, lambda x: x["contribution"] < 0)
    return _sorted_factors(kept, lambda x: x["contribution"])


def by_magnitude(factors: Column) -> Column:
    """All contributions, largest absolute value first."""
    return _sorted_factors(factors, lambda x: -F.abs(x["contribution"]))


def factors_text(factors: Column) -> Column:
    """``name=value`` pairs joined by commas, for display and comparison."""
    return F.array_join(
        F.transform(
            factors, lambda x: F.concat_ws("=", x["feature"], F.format_string("%.4f", x["contribution"]))
        ),
        ",",
    )
