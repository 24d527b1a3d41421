"""Joins of line ranges, without comparing every pair of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK_LINES = 256


def blocks(low: Column, high: Column, width: int = BLOCK_LINES) -> Column:
    """Numbers of the fixed-width line blocks a range touches."""
    return F.sequence(F.floor(low / width), F.floor(high / width))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_range: tuple[str, str],
    right_range: tuple[str, str],
    width: int = BLOCK_LINES,
) -> DataFrame:
    """Pairs with equal ``keys`` whose ranges overlap; each pair comes out once.

    Both sides are cut at block borders and joined on (keys, block), so a hot file spreads over
    its blocks. A pair that shares several blocks is kept in the first one only. Right ranges of
    one file that do not overlap each other (blame runs) leave at most ``width`` candidates per
    left block.
    """
    (ls, le), (rs, re) = left_range, right_range
    lx = left.withColumn("_block", F.explode(blocks(F.col(ls), F.col(le), width)))
    rx = right.withColumn("_block", F.explode(blocks(F.col(rs), F.col(re), width)))
    joined = lx.join(rx, [*keys, "_block"])
    first = F.floor(F.greatest(F.col(ls), F.col(rs)) / width)
    return joined.where(
        (F.col(rs) <= F.col(le)) & (F.col(re) >= F.col(ls)) & (F.col("_block") == first)
    ).drop("_block")


def overlap_exists(
    points: DataFrame,
    ranges: DataFrame,
    keys: list[str],
    query: tuple[str, str],
    extent: tuple[str, str],
    out: str = "overlaps",
) -> DataFrame:
    """Flag each queried range that overlaps any range with the same keys.

    Among the ranges that start at or before the queried end, one overlaps exactly when the
    largest end reaches the queried start: one sorted pass, no pairs.
    """
    qs, qe = query
    s, e = extent
    data = points.columns
    left = points.select(
        *data, F.col(qe).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_end")
    )
    right = ranges.select(
        *keys, F.col(s).cast("bigint").alias("_at"), F.lit(0).alias("_kind"),
        F.col(e).cast("bigint").alias("_end"),
    )
    upto = (
        Window.partitionBy(*keys)
        .orderBy("_at", "_kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    swept = left.unionByName(right, allowMissingColumns=True).withColumn(
        "_reach", F.max("_end").over(upto)
    )
    return swept.where("_kind = 1").select(
        *data, F.coalesce(F.col("_reach") >= F.col(qs), F.lit(False)).alias(out)
    )
