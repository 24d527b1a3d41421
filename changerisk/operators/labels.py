"""Tracing fixes to the commits that introduced the fixed lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from changerisk.functions import commits as fc
from changerisk.operators.provenance import file_lineage, fix_origins, number_revisions
from changerisk.operators.ranges import overlap_join
from changerisk.schema import TARGET
from changerisk.session import materialize

KEY = ["repo", "full_hash"]


def fix_candidates(commits: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Add the four subject signals, the issue ids and ``is_candidate_fix``.

    A candidate has a fix keyword or an issue id and nothing cosmetic; a bare revert is none.
    With ``files`` the number of changed files is added.
    """
    subject = F.col("subject")
    out = (
        commits.withColumns(fc.fix_signals(subject))
        .withColumn("issue_ids", fc.issue_ids(subject))
        .withColumn(
            "is_candidate_fix",
            (F.col("has_fix_keyword") | F.col("has_issue_id")) & ~F.col("is_cosmetic"),
        )
    )
    if files is not None:
        counts = files.groupBy(*KEY).agg(F.count("*").alias("files_changed_count"))
        out = out.join(counts, KEY, "left").withColumn(
            "files_changed_count", F.coalesce("files_changed_count", F.lit(0).cast("bigint"))
        )
    return out


def _blamed(hunks: DataFrame, blame_runs: DataFrame, commit: str, origin: str) -> DataFrame:
    """Pairs of a hunk and a run of another commit whose lines it deleted."""
    usable = hunks.where((F.col("old_count") > 0) & (F.col("old_start") >= 1)).select(
        "repo",
        commit,
        F.col("parent").alias("rev"),
        "path",
        "old_start",
        "old_count",
        (F.col("old_start") + F.col("old_count") - 1).alias("old_end"),
    )
    pairs = overlap_join(
        usable,
        blame_runs.select("repo", "rev", "path", "start_line", "end_line", origin),
        ["repo", "rev", "path"],
        ("old_start", "old_end"),
        ("start_line", "end_line"),
    )
    return pairs.where(F.col(origin) != F.col(commit))


def hunk_origins(hunks: DataFrame, blame_runs: DataFrame) -> DataFrame:
    """Distinct commits that wrote the lines a hunk deleted.

    ``hunks``: repo, full_hash (the fix), parent, path, old_start, old_count.
    ``blame_runs``: repo, rev, path, start_line, end_line, origin_sha.
    Hunks without deleted lines or with an impossible start trace to nothing, and a commit never
    blames itself.
    """
    return (
        _blamed(hunks, blame_runs, "full_hash", "origin_sha")
        .select("repo", "full_hash", "rev", "path", "old_start", "old_count", "origin_sha")
        .distinct()
    )


def introducing_commits(
    hunks: DataFrame, blame_runs: DataFrame, commit: str = "full_hash", origin: str = "origin_sha"
) -> DataFrame:
    """Target 1 for every commit that wrote lines which the hunks, those of the fixes, deleted.

    The same commits as in :func:`label_commits`, for uses that need the target alone: the pairs
    are reduced at once and the facts of the fixes are not joined. ``commit`` and ``origin`` name the
    columns of the two commits, hashes or numbers.
    """
    found = _blamed(hunks, blame_runs, commit, origin).select("repo", F.col(origin).alias(commit)).distinct()
    return found.withColumn(TARGET, F.lit(1))


def trace_fixes(candidates: DataFrame, hunks: DataFrame, blame_runs: DataFrame) -> DataFrame:
    """Evidence rows (introducing commit, fix, confidence, source, lines) of candidate fixes.

    Candidates are filtered before the range join, which leaves out blame of revisions that no
    candidate needs.
    """
    fixes = candidates.where(F.col("is_candidate_fix")).select(
        *KEY, "has_fix_keyword", "has_issue_id", "is_revert", "issue_ids"
    )
    wanted = hunks.join(fixes.select(*KEY), KEY, "left_semi")
    return (
        hunk_origins(wanted, blame_runs)
        .join(fixes, KEY)
        .select(
            "repo",
            F.col("origin_sha").alias("intro_hash"),
            F.col("full_hash").alias("fix_hash"),
            F.array_join("issue_ids", ",").alias("issue_id"),
            fc.fix_confidence(F.col("has_issue_id"), F.col("has_fix_keyword")).alias("confidence"),
            F.col("is_revert"),
            "path",
            F.col("old_count").alias("traced_lines"),
        )
    )


def trace_fixes_in_history(candidates: DataFrame, changes: DataFrame, hunks: DataFrame) -> DataFrame:
    """Evidence rows as of :func:`trace_fixes`, from hunks alone; ``path`` is the file's lineage.

    ``candidates``: :func:`fix_candidates` of one line of history (first parents) with ``seq``;
    ``changes``: repo, seq, full_hash, status, old_path, path; ``hunks``: repo, full_hash, path and the
    four hunk numbers. Lines are followed through renames back to the commits that wrote them.
    """
    lives = file_lineage(changes).select("repo", "full_hash", "path", "lineage").distinct()
    order = candidates.select(*KEY, "seq")
    history = materialize(number_revisions(hunks.join(lives, [*KEY, "path"]).join(order, KEY)))
    fixes = candidates.where(F.col("is_candidate_fix"))
    runs = fix_origins(history, fixes).select("repo", "lineage", "full_hash", "old_start", "old_count", "origin_sha").distinct()
    about = fixes.select(*KEY, "has_fix_keyword", "has_issue_id", "is_revert", "issue_ids")
    return runs.join(about, KEY).select(
        "repo",
        F.col("origin_sha").alias("intro_hash"),
        F.col("full_hash").alias("fix_hash"),
        F.array_join("issue_ids", ",").alias("issue_id"),
        fc.fix_confidence(F.col("has_issue_id"), F.col("has_fix_keyword")).alias("confidence"),
        F.col("is_revert"),
        F.col("lineage").alias("path"),
        F.col("old_count").alias("traced_lines"),
    )


def evidence_summary(evidence: DataFrame) -> DataFrame:
    """One row per introducing commit.

    Rows are first reduced per (introducing commit, fix), which spreads a commit that collects
    most of the blame; what is left per commit is one hash per fix, told apart in full and shown short.
    """
    rank = F.when(F.col("confidence") == "HIGH", 3).when(F.col("confidence") == "MEDIUM", 2).otherwise(1)
    per_fix = evidence.groupBy("repo", "intro_hash", "fix_hash").agg(
        F.max(rank).alias("rank"),
        F.bool_or("is_revert").alias("is_revert"),
        F.sum("traced_lines").alias("lines"),
        F.max("issue_id").alias("issue_id"),
    )
    return per_fix.groupBy("repo", "intro_hash").agg(
        F.transform(F.array_sort(F.collect_list("fix_hash")), fc.short_hash).alias("fixing_commits"),
        F.array_sort(F.collect_set(F.nullif(F.col("issue_id"), F.lit("")))).alias("fixing_issues"),
        F.max("rank").alias("rank"),
        F.bool_or("is_revert").alias("is_revert"),
        F.sum("lines").alias("traced_lines_count"),
    )


def label_commits(commits: DataFrame, evidence: DataFrame) -> DataFrame:
    """A label row for every commit; without evidence the defaults apply."""
    found = evidence_summary(evidence).withColumnRenamed("intro_hash", "full_hash")
    joined = commits.join(found, KEY, "left")
    labeled = F.col("rank").isNotNull()
    empty = F.array().cast("array<string>")
    extra = [c for c in commits.columns if c not in KEY]
    return joined.select(
        "repo",
        fc.short_hash(F.col("full_hash")).alias("commit_hash"),
        "full_hash",
        *extra,
        labeled.cast("int").alias("bug_introduced"),
        fc.label_semantics(labeled).alias("label_semantics"),
        fc.label_source(F.col("is_revert")).alias("label_source"),
        F.when(F.col("rank") == 3, "HIGH")
        .when(F.col("rank") == 2, "MEDIUM")
        .when(F.col("rank") == 1, "LOW")
        .otherwise("NONE")
        .alias("label_confidence"),
        F.coalesce("fixing_commits", empty).alias("fixing_commits"),
        F.coalesce("fixing_issues", empty).alias("fixing_issues"),
        F.coalesce("traced_lines_count", F.lit(0)).alias("traced_lines_count"),
    )


def label_audit(evidence: DataFrame, labels: DataFrame) -> DataFrame:
    """Label histograms and linkage counts as (section, name, n) rows.

    Linkages and ids are counted on the evidence rows, not by unfolding the label lists.
    """

    def histogram(column: str):
        return labels.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n")).select(
            F.lit(column).alias("section"), "name", "n"
        )

    links = evidence.select("repo", "intro_hash", "fix_hash").distinct()
    per_commit = links.groupBy("repo", "intro_hash").agg(F.count("*").alias("fixes"))
    linkage = per_commit.agg(
        F.coalesce(F.sum("fixes"), F.lit(0)).alias("fix_linkages"),
        F.count_if(F.col("fixes") > 1).alias("multi_fix_commits"),
    ).unpivot([], ["fix_linkages", "multi_fix_commits"], "name", "n")
    ids = (
        evidence.where(F.col("issue_id") != "")
        .select("repo", F.explode(F.split("issue_id", ",")).alias("id"))
        .distinct()
        .agg(F.count("*").alias("n"))
        .select(F.lit("issue_ids").alias("name"), "n")
    )
    totals = linkage.unionByName(ids).select(F.lit("totals").alias("section"), "name", "n")
    return (
        histogram("label_confidence")
        .unionByName(histogram("label_source"))
        .unionByName(totals)
    )
