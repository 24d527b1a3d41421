"""Expressions over commit metadata."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from changerisk.functions.rounding import round_exact

# Word lists and id pattern of fix detection, case-insensitive.
FIX_WORDS = (
    "fix|fixes|fixed|bug|bugs|issue|issues|resolve|resolves|resolved|defect|patch|error|crash|panic"
)
COSMETIC_WORDS = "typo|formatting|indentation|docs|style|readme|lint"
ISSUE_ID = r"\b(GH-\d+|JIRA-\d+|#\d+|[Ii]ssue\s*#?\d+)\b"
REVERT = r"^(Revert\s+|\b(revert|reverted|reverting)\b)"
# Texts of the label table.
SEMANTICS_TRACED = "SZZ-identified bug-introducing commit"
SEMANTICS_NONE = "No SZZ evidence that the commit introduced a later fixed defect"

# (?U) makes \b, \d and \s follow Unicode, as the original text patterns do.
_WORDS = "(?iU)"


def short_hash(full_hash: Column) -> Column:
    return F.substring(full_hash, 1, 7)


def has_fix_keyword(subject: Column) -> Column:
    return subject.rlike(rf"{_WORDS}\b({FIX_WORDS})\b")


def has_issue_id(subject: Column) -> Column:
    return subject.rlike(_WORDS + ISSUE_ID)


def is_revert(subject: Column) -> Column:
    return subject.rlike(_WORDS + REVERT)


def is_cosmetic(subject: Column) -> Column:
    return subject.rlike(rf"{_WORDS}\b({COSMETIC_WORDS})\b")


def fix_signals(subject: Column) -> dict[str, Column]:
    """The four flags of a commit subject, by column name."""
    return {
        "has_fix_keyword": has_fix_keyword(subject),
        "has_issue_id": has_issue_id(subject),
        "is_revert": is_revert(subject),
        "is_cosmetic": is_cosmetic(subject),
    }


def issue_ids(subject: Column) -> Column:
    """Distinct issue ids of a subject, sorted."""
    found = F.regexp_extract_all(subject, F.lit(_WORDS + ISSUE_ID), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def fix_confidence(has_id: Column, has_keyword: Column) -> Column:
    return F.when(has_id & has_keyword, "HIGH").when(has_id | has_keyword, "MEDIUM").otherwise("LOW")


def label_source(revert: Column) -> Column:
    """Source of traced evidence; null (no evidence) gives the unlabeled value."""
    return (
        F.when(revert.isNull(), "unlabeled_no_evidence")
        .when(revert, "revert_trace")
        .otherwise("szz_blame_traced")
    )


def label_semantics(labeled: Column) -> Column:
    return F.when(labeled, SEMANTICS_TRACED).otherwise(SEMANTICS_NONE)


def to_utc(stamp: Column) -> Column:
    """Instant of an ISO-8601 text with offset; text without offset is read as UTC."""
    zoned = F.when(stamp.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), stamp).otherwise(F.concat(stamp, F.lit("Z")))
    return F.try_to_timestamp(zoned)


def avg_lines(churn: Column, files: Column) -> Column:
    return round_exact(churn.cast("double") / F.greatest(F.lit(1), files), 2)


def churn_columns(added: Column, deleted: Column, files: Column) -> dict[str, Column]:
    churn = added + deleted
    return {"code_churn": churn, "avg_lines_changed_per_file": avg_lines(churn, files)}


def impute_features() -> dict[str, Column]:
    """Defaults of the feature vector when only the four basic counts are known."""
    c = F.col
    churn = F.coalesce(c("code_churn"), c("lines_added") + c("lines_deleted"))
    avg = F.coalesce(c("avg_lines_changed_per_file"), avg_lines(churn, c("files_changed")))
    biggest = F.greatest(avg, churn.cast("double") * F.lit(0.7)).cast("bigint")
    return {
        "code_churn": churn,
        "avg_lines_changed_per_file": avg,
        "max_lines_changed_in_single_file": F.coalesce(c("max_lines_changed_in_single_file"), biggest),
        "num_source_files_changed": F.coalesce(
            c("num_source_files_changed"), F.greatest(F.lit(1), c("files_changed"))
        ),
        "num_directories_touched": F.coalesce(c("num_directories_touched"), F.lit(1)),
        "is_test_file_modified": F.coalesce(c("is_test_file_modified"), F.lit(0)),
    }


def skip_reason(parent_count: Column, files: Column) -> Column:
    """Why a commit cannot be scored; null when it can."""
    return F.when(parent_count > 1, "merge_commit").when(files == 0, "empty_commit")


# Shapes of hashes and names, and sequences a ref may not contain.
SHA1 = "^[0-9a-fA-F]{40}$"
REPO_NAME = "^[a-zA-Z0-9_.-]+$"
BANNED_IN_REF = ["..", "@{", ":", "^", "~", "?", "*", "[", "\\", "//"]


def valid_sha1(value: Column) -> Column:
    return F.coalesce(value.rlike(SHA1), F.lit(False))


def valid_repo_name(value: Column) -> Column:
    return F.coalesce(value.rlike(REPO_NAME), F.lit(False))


def ref_reject_reason(ref: Column) -> Column:
    """First rule a git reference breaks; null for an acceptable one."""
    name = F.regexp_replace(F.coalesce(ref, F.lit("")), r"(?U)^\s+|\s+$", "")
    reason = (
        F.when(name == "", "empty")
        .when(F.startswith(name, F.lit("-")), "leading_hyphen")
        .when(name.rlike(r"(?U)[\s\x00-\x1f\x7f]"), "whitespace_or_control")
    )
    for bad in BANNED_IN_REF:
        reason = reason.when(F.contains(name, F.lit(bad)), F.lit("prohibited_sequence " + bad))
    return reason.when(name.rlike(r"[/.]$"), "bad_ending")
