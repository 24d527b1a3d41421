"""Column contracts shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Canonical feature names in mandatory order.
FEATURES = [
    "lines_added",
    "lines_deleted",
    "code_churn",
    "files_changed",
    "functions_changed",
    "num_directories_touched",
    "is_test_file_modified",
    "avg_lines_changed_per_file",
    "max_lines_changed_in_single_file",
    "num_source_files_changed",
]
TARGET = "bug_introduced"
IDENTIFIERS = ["commit_hash", "commit_timestamp"]
DATASET_COLUMNS = IDENTIFIERS + FEATURES + [TARGET]

# Label provenance columns that must never reach a training table.
PROVENANCE = [
    "fixing_commit_hash",
    "fixing_issue_id",
    "label_confidence",
    "label_source",
    "label_semantics",
    "traced_lines_count",
]

# Decision thresholds of the sweep, in hundredths, and the production cut.
SWEEP_PERCENT = list(range(10, 95, 5))
PRODUCTION_THRESHOLD = 0.35

FEATURE_TYPES = T.StructType(
    [
        T.StructField(
            name,
            T.DoubleType() if name == "avg_lines_changed_per_file" else T.LongType(),
        )
        for name in FEATURES
    ]
)

FEATURE_TABLE = T.StructType(
    [T.StructField("commit_hash", T.StringType()), T.StructField("commit_timestamp", T.StringType())]
    + FEATURE_TYPES.fields
    + [T.StructField(TARGET, T.IntegerType())]
)

EVENT_SOURCE = T.StructType(
    [
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("body", T.BinaryType()),
        T.StructField("received_at", T.TimestampType()),
    ]
)

# Sections a benchmark report must have.
REPORT_SECTIONS = [
    "metadata",
    "production_logistic_regression_anchor",
    "benchmark_candidates",
    "benchmark_summary",
]
