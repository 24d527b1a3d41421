"""Per-commit features from exported change facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from changerisk.functions import commits as fc, paths as fp
from changerisk.schema import FEATURES

KEY = ["repo", "full_hash"]


def drop_merges(commits: DataFrame, include_merges: bool = False) -> DataFrame:
    """Keep commits with at most one parent; root commits stay."""
    return commits if include_merges else commits.where(F.size("parents") <= 1)


def latest_n(commits: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` commits of each repository, numbered oldest first.

    The rank filter is pushed below the shuffle (group limit), so a task passes on at most ``n``
    rows per repository.
    """
    newest = Window.partitionBy("repo").orderBy(F.desc("seq"), F.desc("full_hash"))
    kept = commits.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= n)
    oldest = Window.partitionBy("repo").orderBy("seq", "full_hash")
    return kept.withColumn("ordinal", F.row_number().over(oldest)).drop("_back")


def parse_counts(changes: DataFrame, compat: bool = False) -> DataFrame:
    """Typed numstat rows: clean path, line counts (0 for binary), binary flag, file churn."""
    binary = (F.col("added") == "-") | (F.col("deleted") == "-")
    count = lambda c: F.when(binary, F.lit(0)).otherwise(F.col(c).try_cast("bigint"))
    return changes.select(
        *[c for c in changes.columns if c not in ("added", "deleted", "raw_path")],
        "raw_path",
        fp.clean_rename_path(F.col("raw_path"), compat).alias("path"),
        count("added").cast("bigint").alias("added"),
        count("deleted").cast("bigint").alias("deleted"),
        binary.alias("is_binary"),
    ).withColumn("file_churn", F.col("added") + F.col("deleted"))


def functions_changed(hunks: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Number of hunks per commit, the estimate of functions touched."""
    return hunks.groupBy(*(key or KEY)).agg(F.count("*").alias("functions_changed"))


def file_facts(files: DataFrame, key: list[str] | None = None) -> DataFrame:
    """What the features take from each file of :func:`parse_counts`: narrow rows without its path."""
    path = F.col("path")
    return files.select(
        *(key or KEY),
        fp.directory_of(path).alias("_dir"),
        "added",
        "deleted",
        "file_churn",
        fp.is_test_file(path).cast("int").alias("_test"),
        fp.is_source_file(path).cast("int").alias("_source"),
    )


def commit_features(
    commits: DataFrame, files: DataFrame, hunks: DataFrame | None = None, key: list[str] | None = None
) -> DataFrame:
    """The ten features of every commit; commits without files get zeros.

    ``files`` comes from :func:`parse_counts`, or from :func:`file_facts` of it. Directories are
    reduced first, so the distinct count adds no expansion of the file rows and a huge commit is
    combined on the map side. ``key``: columns that name a commit in all three tables, if not its hash.
    """
    key = key or KEY
    facts = files if "_dir" in files.columns else file_facts(files, key)
    per_dir = facts.groupBy(*key, "_dir").agg(
        F.sum("added").alias("added"),
        F.sum("deleted").alias("deleted"),
        F.count("*").alias("files"),
        F.max("_test").alias("test"),
        F.max("file_churn").alias("biggest"),
        F.sum("_source").alias("sources"),
    )
    per_commit = per_dir.groupBy(*key).agg(
        F.sum("added").alias("lines_added"),
        F.sum("deleted").alias("lines_deleted"),
        F.sum("files").alias("files_changed"),
        F.count("*").alias("num_directories_touched"),
        F.max("test").alias("is_test_file_modified"),
        F.max("biggest").alias("max_lines_changed_in_single_file"),
        F.sum("sources").alias("num_source_files_changed"),
    )
    joined = commits.join(per_commit, key, "left")
    if hunks is None:
        joined = joined.withColumn("functions_changed", F.lit(0).cast("bigint"))
    else:
        joined = joined.join(functions_changed(hunks, key), key, "left")
    counted = joined.withColumns(
        {
            f: F.coalesce(F.col(f), F.lit(0)).cast("bigint")
            for f in FEATURES
            if f not in ("code_churn", "avg_lines_changed_per_file")
        }
    )
    filled = counted.withColumns(
        fc.churn_columns(F.col("lines_added"), F.col("lines_deleted"), F.col("files_changed"))
    )
    extra = [c for c in commits.columns if c not in (*KEY, "commit_hash")]
    return filled.select(
        "repo", fc.short_hash(F.col("full_hash")).alias("commit_hash"), "full_hash", *extra, *FEATURES
    )


def scorable(features: DataFrame) -> DataFrame:
    """Add ``skip_reason`` (merge before empty); rows without one can be scored."""
    reason = fc.skip_reason(F.size("parents"), F.col("files_changed"))
    return features.withColumn("skip_reason", reason)


def log_audit(features: DataFrame) -> DataFrame:
    """Counts over a commit log per repository: zero churn, tests touched, several directories."""
    return features.groupBy("repo").agg(
        F.count("*").alias("commits"),
        F.count_if(F.col("code_churn") == 0).alias("zero_churn"),
        F.count_if(F.col("is_test_file_modified") == 1).alias("test_touching"),
        F.count_if(F.col("num_directories_touched") > 1).alias("multi_directory"),
    )
