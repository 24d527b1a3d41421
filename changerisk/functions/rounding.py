"""Decimal rounding that agrees with the exact value of a double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_exact(value: Column, digits: int) -> Column:
    """Round half to even on the exact binary value of ``value``.

    ``round`` and ``bround`` judge ties on the printed decimal, so 0.265 counts as a tie although
    the double lies above it. Here the product with 10**digits is split (Dekker) into a rounded
    product and its exact error, and the error decides what looks like a tie. From 2**53 /
    10**digits on, doubles are no closer together than the decimals, and a value stays itself.
    """
    scale = float(10**digits)
    v = value.cast("double")
    p = v * F.lit(scale)
    big = v * F.lit(134217729.0)
    hi = big - (big - v)
    err = (hi * scale - p) + (v - hi) * scale
    low = F.floor(p).cast("double")
    side = (p - low - F.lit(0.5)) + err
    odd = (F.abs(low) % 2) == 1
    whole = F.when(side > 0, low + 1).when(side < 0, low).when(odd, low + 1).otherwise(low)
    usable = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float(2**53) / scale))
    return F.when(usable, whole / F.lit(scale)).otherwise(v)


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, and 0 when the denominator is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))
