"""Joining features with labels, dataset checks and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from changerisk.functions import commits as fc
from changerisk.functions.rounding import round_exact
from changerisk.operators.ordered import row_positions
from changerisk.schema import FEATURES, PROVENANCE, TARGET

KEY = ["repo", "full_hash"]


def duplicate_keys(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*(keys or KEY)).agg(F.count("*").alias("copies")).where("copies > 1")


def join_labels(features: DataFrame, labels: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Left join on the full hash, or on ``key``; only the target is taken, a missing label is 0."""
    key = key or KEY
    target = labels.select(*key, F.col(TARGET).cast("int").alias("_label"))
    return (
        features.join(target, key, "left")
        .withColumn(TARGET, F.coalesce("_label", F.lit(0)))
        .drop("_label")
    )


def join_coverage(features: DataFrame, labels: DataFrame) -> DataFrame:
    """How many commits have features only or labels only, in one pass over both key sets."""
    sides = (
        features.select(*KEY, F.lit(1).alias("f"), F.lit(0).alias("l"))
        .unionByName(labels.select(*KEY, F.lit(0).alias("f"), F.lit(1).alias("l")))
        .groupBy(*KEY)
        .agg(F.max("f").alias("f"), F.max("l").alias("l"))
    )
    return sides.agg(
        F.count_if((F.col("f") == 1) & (F.col("l") == 0)).alias("features_only"),
        F.count_if((F.col("f") == 0) & (F.col("l") == 1)).alias("labels_only"),
        F.count_if((F.col("f") == 1) & (F.col("l") == 1)).alias("matched"),
    )


def quality_report(dataset: DataFrame, time_column: str = "ts") -> DataFrame:
    """One row of counts: nulls, broken invariants, class mix, time range, leaked columns."""
    churn_ok = F.col("code_churn") == F.col("lines_added") + F.col("lines_deleted")
    leaked = sorted(set(PROVENANCE) & set(dataset.columns))
    numeric = {"bigint", "int", "double", "float", "smallint", "tinyint"}
    non_numeric = [n for n, t in dataset.dtypes if n in FEATURES and t not in numeric]
    total = F.count("*")
    positives = F.count_if(F.col(TARGET) == 1)
    return dataset.agg(
        total.alias("total_rows"),
        *[F.count_if(F.col(f).isNull()).alias(f"null_{f}") for f in FEATURES],
        F.count_if(~churn_ok).alias("churn_mismatches"),
        F.count_if(~F.col(TARGET).isin(0, 1) | F.col(TARGET).isNull()).alias("invalid_targets"),
        positives.alias("label_1_count"),
        F.count_if(F.col(TARGET) == 0).alias("label_0_count"),
        round_exact(positives * 100.0 / total, 2).alias("percentage_label_1"),
        F.count_if(F.col(time_column).isNull()).alias("null_timestamps"),
        F.min(time_column).alias("min_timestamp"),
        F.max(time_column).alias("max_timestamp"),
    ).withColumns(
        {
            "leaked_columns": F.lit(",".join(leaked)),
            "non_numeric_features": F.lit(",".join(non_numeric)),
        }
    )


def require_columns(df: DataFrame, columns: list[str]) -> None:
    """Fail before any job when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def temporal_split(
    dataset: DataFrame,
    train: float = 0.70,
    validation: float = 0.15,
    order: tuple[str, ...] = ("ts", "seq", "full_hash"),
) -> DataFrame:
    """Chronological split per repository; sizes are half-even shares of the row count.

    Positions come from :func:`row_positions`, so one repository with most of the rows is still
    sorted by many tasks. The rows themselves are placed, not looked up by their values: rows that
    repeat each keep a place, and a null repository is a repository. A row without an instant has
    no place in time: its split is ``undated``, and it counts for no share. Such rows are a group
    beside the others, so that ``dataset`` is worked out once.
    """
    undated = F.col("_undated")
    marked = dataset.withColumn("_undated", F.col(order[0]).isNull())
    placed = row_positions(marked, ["repo", "_undated"], list(order))
    n = F.col("position_total")
    first = F.bround(n * F.lit(train)).cast("bigint")
    second = first + F.bround(n * F.lit(validation)).cast("bigint")
    split = (
        F.when(undated, "undated")
        .when(F.col("position") <= first, "train")
        .when(F.col("position") <= second, "validation")
        .otherwise("test")
    )
    return placed.select(*dataset.columns, F.when(~undated, F.col("position")).alias("position"), split.alias("split"))


def is_chronological(dataset: DataFrame, block_rows: int = 1_000_000) -> DataFrame:
    """Whether time never falls in ``seq`` order, per repository.

    Each block of ``block_rows`` consecutive rows is checked with ``lag``, and then the blocks'
    first and last instants are compared, so no task sorts a whole repository.
    """
    placed = row_positions(dataset.select("repo", "seq", "full_hash", "ts"), ["repo"], ["seq", "full_hash"])
    block = F.expr(f"(position - 1) div {block_rows}")
    blocked = placed.withColumn("_b", block)
    inside = Window.partitionBy("repo", "_b").orderBy("position")
    fell = F.coalesce((F.col("ts") < F.lag("ts").over(inside)).cast("int"), F.lit(0))
    blocks = (
        blocked.withColumn("_fell", fell)
        .groupBy("repo", "_b")
        .agg(
            F.sum("_fell").alias("falls"),
            F.min_by("ts", "position").alias("first_ts"),
            F.max_by("ts", "position").alias("last_ts"),
            F.count("*").alias("n"),
        )
    )
    across = Window.partitionBy("repo").orderBy("_b")
    broke = F.coalesce((F.col("first_ts") < F.lag("last_ts").over(across)).cast("int"), F.lit(0))
    return (
        blocks.withColumn("_broke", broke)
        .groupBy("repo")
        .agg(F.sum("n").alias("rows"), F.sum(F.col("falls") + F.col("_broke")).alias("falls"))
        .withColumn("is_chronological", F.col("falls") == 0)
    )


def stratified_split(
    dataset: DataFrame, key: list[str], share: float = 0.2, seed: int = 42, label: str = TARGET
) -> DataFrame:
    """Hold out a share of every class, chosen by a seeded hash of the key.

    The hash order replaces a random generator, so membership depends on the row alone.
    """
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    placed = row_positions(dataset.withColumn("_draw", draw), [label], ["_draw", *key])
    cut = F.bround(F.col("position_total") * F.lit(share)).cast("bigint")
    return placed.withColumn(
        "split", F.when(F.col("position") <= cut, "test").otherwise("train")
    ).drop("_draw", "position", "position_total")


def class_distribution(df: DataFrame, groups: list[str], label: str = TARGET) -> DataFrame:
    """Class counts and percentages per group."""
    pos, neg, total = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0), F.count("*")
    return df.groupBy(*groups).agg(
        total.alias("total_rows"),
        pos.alias("positive_count"),
        neg.alias("negative_count"),
        round_exact(pos * 100.0 / total, 2).alias("positive_pct"),
        round_exact(neg * 100.0 / total, 2).alias("negative_pct"),
    )


def split_overlap(splits: DataFrame) -> DataFrame:
    """Pairwise overlaps of commit hashes across the three splits of each repository.

    One aggregation marks the splits of a hash; the reference hash sets are never built.
    """
    has = {s: F.max((F.col("split") == s).cast("int")) for s in ("train", "validation", "test")}
    marks = splits.groupBy("repo", "full_hash").agg(*[c.alias(s) for s, c in has.items()])

    def both(a: str, b: str):
        return F.count_if((F.col(a) == 1) & (F.col(b) == 1))

    return (
        marks.groupBy("repo")
        .agg(
            both("train", "validation").alias("train_validation"),
            both("validation", "test").alias("validation_test"),
            both("train", "test").alias("train_test"),
        )
        .withColumn(
            "total_overlap",
            F.col("train_validation") + F.col("validation_test") + F.col("train_test"),
        )
    )


def split_report(splits: DataFrame) -> DataFrame:
    """Per repository: split sizes, time order of the boundaries, overlap, class mix of the test."""

    def at(split: str, value):
        return F.when(F.col("split") == split, value)

    parts = splits.groupBy("repo").agg(
        F.count("*").alias("total_rows"),
        *[F.count_if(F.col("split") == s).alias(f"{s}_rows") for s in ("train", "validation", "test")],
        F.max(at("train", F.col("ts"))).alias("train_max"),
        F.min(at("validation", F.col("ts"))).alias("validation_min"),
        F.max(at("validation", F.col("ts"))).alias("validation_max"),
        F.min(at("test", F.col("ts"))).alias("test_min"),
        F.count_if((F.col("split") == "test") & (F.col(TARGET) == 1)).alias("test_positives"),
        F.count_if((F.col("split") == "test") & (F.col(TARGET) == 0)).alias("test_negatives"),
    )
    overlap = split_overlap(splits).select("repo", "total_overlap")
    return (
        parts.join(overlap, "repo")
        .withColumns(
            {
                "checksum_valid": F.col("train_rows") + F.col("validation_rows") + F.col("test_rows")
                == F.col("total_rows"),
                "train_to_validation_ordered": F.coalesce(
                    F.col("train_max") <= F.col("validation_min"), F.lit(True)
                ),
                "validation_to_test_ordered": F.coalesce(
                    F.col("validation_max") <= F.col("test_min"), F.lit(True)
                ),
                "test_has_both_classes": (F.col("test_positives") > 0) & (F.col("test_negatives") > 0),
            }
        )
        .drop("train_max", "validation_min", "validation_max", "test_min")
    )


def with_instant(df: DataFrame, column: str = "commit_timestamp", out: str = "ts") -> DataFrame:
    return df.withColumn(out, fc.to_utc(F.col(column)))
