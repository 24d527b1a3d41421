"""Order-dependent building blocks that hold when one group has most of the rows.

A plain window sorts a whole group in one task. Here the rows are range-partitioned on group and
order, the slices are fixed by a reliable checkpoint, and a window runs inside each slice only;
what the earlier slices of the same group hold is added from a table with one row per
(group, slice).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from changerisk.session import materialize

_SLICE = "_slice"


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    measures: dict[str, str | Column],
) -> DataFrame:
    """Add running sums (current row included) of ``measures`` within ``keys`` by ``order``.

    ``order`` must be unique within a group. Result columns are named by the keys of
    ``measures``; the group totals come along as ``<name>_total``.
    """
    staged = df.select("*", *[_as_col(m).alias(f"_m_{n}") for n, m in measures.items()])
    # No slice count is given, so adaptive execution may merge neighbouring small slices.
    ranged = staged.repartitionByRange(*keys, *order).withColumn(_SLICE, F.spark_partition_id())
    fixed = materialize(ranged)
    sums = [F.sum(f"_m_{n}").alias(f"_s_{n}") for n in measures]
    per_slice = fixed.groupBy(*keys, _SLICE).agg(*sums)
    across = Window.partitionBy(*keys)
    before = across.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *keys,
        _SLICE,
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in measures],
        *[F.sum(f"_s_{n}").over(across).alias(f"{n}_total") for n in measures],
    )
    inside = (
        Window.partitionBy(*keys, _SLICE)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = fixed.select(
        "*", *[F.sum(f"_m_{n}").over(inside).alias(f"_r_{n}") for n in measures]
    )
    joined = join_groups(local, offsets, [*keys, _SLICE])
    return joined.select(
        *[c for c in df.columns],
        *[(F.col(f"_r_{n}") + F.col(f"_o_{n}")).alias(n) for n in measures],
        *[f"{n}_total" for n in measures],
    )


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equality join on columns of the same name in which a null group meets the null group."""
    renamed = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return left.join(renamed, match, how).drop(*[f"_key_{k}" for k in keys])


def row_positions(df: DataFrame, keys: list[str], order: list[str], out: str = "position") -> DataFrame:
    """1-based position of each row in its group, and the group size as ``<out>_total``."""
    return running_totals(df, keys, order, {out: F.lit(1).cast("bigint")})


def exact_medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact median per group: values are counted first, then ranked by cumulative count."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    ranked = running_totals(counted, keys, [value], {"upto": "n"})
    low = F.expr("(upto_total + 1) div 2")
    high = F.expr("(upto_total + 2) div 2")
    start = F.col("upto") - F.col("n")
    weight = ((start < low) & (low <= F.col("upto"))).cast("int") + (
        (start < high) & (high <= F.col("upto"))
    ).cast("int")
    return ranked.groupBy(*keys).agg(
        (F.sum(weight * F.col(value)) / F.lit(2.0)).alias("median")
    )


def _as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c
