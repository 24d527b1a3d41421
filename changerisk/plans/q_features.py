"""Queries of sources, features, datasets, splits and statistics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from changerisk.functions import commits as fc
from changerisk.operators import dataset as ds, features as ft, labels as lb, stats as st
from changerisk.plans.adapters import with_adapters as wa
from changerisk.plans.catalog import query
from changerisk.plans.q_scalar import CLEAN, DIR, EXT, EXT_LIST, SIGNALS, TEST_RE
from changerisk.schema import FEATURES
from changerisk.sources import readers as rd

c = F.col

# --- oracle parts ----------------------------------------------------------------------------
FILES = f"""SELECT repo, full_hash, raw_path, {CLEAN} AS path, (added = '-' OR deleted = '-') AS is_binary,
  CASE WHEN added = '-' OR deleted = '-' THEN 0 ELSE CAST(added AS BIGINT) END AS a,
  CASE WHEN added = '-' OR deleted = '-' THEN 0 ELSE CAST(deleted AS BIGINT) END AS d FROM v_changes"""
FEAT = f"""SELECT k.repo, k.full_hash, substr(k.full_hash, 1, 7) AS commit_hash, k.seq, k.commit_timestamp, k.n_parents,
  coalesce(la, 0) AS lines_added, coalesce(ld, 0) AS lines_deleted, coalesce(la + ld, 0) AS code_churn,
  coalesce(nf, 0) AS files_changed, coalesce(h.n, 0) AS functions_changed, coalesce(nd, 0) AS num_directories_touched,
  CAST(coalesce(tst, 0) AS BIGINT) AS is_test_file_modified,
  (CAST(printf('%.2f', CAST(coalesce(la + ld, 0) AS DOUBLE) / greatest(1, coalesce(nf, 0))) AS DOUBLE) + 0.0::DOUBLE) AS avg_lines_changed_per_file,
  coalesce(mx, 0) AS max_lines_changed_in_single_file, coalesce(src, 0) AS num_source_files_changed
FROM v_commits k LEFT JOIN (
  SELECT repo, full_hash, CAST(sum(a) AS BIGINT) AS la, CAST(sum(d) AS BIGINT) AS ld, count(*) AS nf, count(DISTINCT {DIR}) AS nd,
    max(CASE WHEN regexp_matches(path, '{TEST_RE}') THEN 1 ELSE 0 END) AS tst, max(a + d) AS mx,
    CAST(sum(CASE WHEN {EXT} IN ({EXT_LIST}) THEN 1 ELSE 0 END) AS BIGINT) AS src
  FROM files GROUP BY repo, full_hash) f ON f.repo = k.repo AND f.full_hash = k.full_hash
LEFT JOIN (SELECT repo, full_hash, count(*) AS n FROM v_hunks GROUP BY repo, full_hash) h
  ON h.repo = k.repo AND h.full_hash = k.full_hash"""
ORIGINS = """SELECT DISTINCT h.repo, h.full_hash, h.parent AS rev, h.path, h.old_start, h.old_count, b.origin_sha
FROM v_hunks h JOIN v_blame_runs b ON b.repo = h.repo AND b.rev = h.parent AND b.path = h.path
 AND b.start_line <= h.old_start + h.old_count - 1 AND b.end_line >= h.old_start
WHERE h.old_count > 0 AND h.old_start >= 1 AND b.origin_sha <> h.full_hash"""
EVIDENCE = """SELECT o.repo, o.origin_sha AS intro_hash, o.full_hash AS fix_hash, s.issue_ids AS issue_id, s.is_revert,
  CASE WHEN has_issue_id AND has_fix_keyword THEN 3 ELSE 2 END AS rnk, o.path, o.old_count AS traced_lines
FROM origins o JOIN signals s ON s.repo = o.repo AND s.full_hash = o.full_hash
WHERE (has_fix_keyword OR has_issue_id) AND NOT is_cosmetic"""
SUMMARY = """SELECT repo, intro_hash, array_to_string(list_transform(list_sort(list_distinct(list(fix_hash))), lambda x: substr(x, 1, 7)), ',') AS fixing_commits,
  coalesce(array_to_string(list_sort(list_distinct(list(issue_id) FILTER (issue_id <> ''))), ','), '') AS fixing_issues,
  max(rnk) AS rnk, bool_or(is_revert) AS is_revert, CAST(sum(traced_lines) AS BIGINT) AS traced_lines_count
FROM evidence GROUP BY repo, intro_hash"""
LABELS = f"""SELECT k.repo, k.full_hash, k.seq, CASE WHEN s.rnk IS NULL THEN 0 ELSE 1 END AS bug_introduced,
  CASE WHEN s.rnk IS NULL THEN '{fc.SEMANTICS_NONE}' ELSE '{fc.SEMANTICS_TRACED}' END AS label_semantics,
  CASE WHEN s.rnk IS NULL THEN 'unlabeled_no_evidence' WHEN is_revert THEN 'revert_trace' ELSE 'szz_blame_traced' END AS label_source,
  CASE s.rnk WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'NONE' END AS label_confidence,
  coalesce(fixing_commits, '') AS fixing_commits, coalesce(fixing_issues, '') AS fixing_issues,
  coalesce(traced_lines_count, 0) AS traced_lines_count
FROM v_commits k LEFT JOIN summary s ON s.repo = k.repo AND s.intro_hash = k.full_hash"""
DATASET = """SELECT f.*, epoch_us(CAST(f.commit_timestamp AS TIMESTAMPTZ)) AS ts, coalesce(l.bug_introduced, 0) AS bug_introduced
FROM feat f LEFT JOIN labels l ON l.repo = f.repo AND l.full_hash = f.full_hash WHERE f.n_parents <= 1"""
SPLITS = """SELECT *, CASE WHEN pos <= n1 THEN 'train' WHEN pos <= n1 + n2 THEN 'validation' ELSE 'test' END AS split FROM (
  SELECT *, CAST(round_even(n * 0.7::DOUBLE, 0) AS BIGINT) AS n1, CAST(round_even(n * 0.15::DOUBLE, 0) AS BIGINT) AS n2 FROM (
    SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts, seq, full_hash) AS pos, count(*) OVER (PARTITION BY repo) AS n
    FROM dataset) a) b"""
P_FEAT = {"files": FILES, "feat": FEAT}
P_EVID = {"signals": SIGNALS, "origins": ORIGINS, "evidence": EVIDENCE, "summary": SUMMARY}
P_LABEL = {**P_EVID, "labels": LABELS}
P_DATA = {**P_FEAT, **P_LABEL, "dataset": DATASET}
P_SPLIT = {**P_DATA, "splits": SPLITS}
V_ALL = ["v_commits", "v_changes", "v_hunks", "v_blame_runs"]
FLIST = ", ".join(FEATURES)


# --- shared frames ---------------------------------------------------------------------------
def commits(t):
    return t.v_commits.withColumn("parents", F.array_repeat(F.lit("p"), c("n_parents")))


NUMBER = ["repo", "seq"]


def features(t):
    """Commits are named by their number; files are cut down to what the features need before they meet them."""
    files = ft.file_facts(ft.parse_counts(t.v_numstat.select("seq", "raw_path", "added", "deleted")), ["seq"])
    names = t.v_commits.select(*NUMBER)
    return ft.commit_features(t.v_commits, files.join(names, "seq"), t.n_hunks.select("seq").join(names, "seq"), NUMBER)


def evidence(t):
    return lb.trace_fixes(lb.fix_candidates(t.v_commits), t.v_hunks, t.v_blame_runs)


def labels(t):
    return lb.label_commits(t.v_commits.select("repo", "full_hash", "seq"), evidence(t))


def targets(t):
    """Target 1 for the commits that :func:`labels` labels, by number."""
    fixes = lb.fix_candidates(t.v_commits).where("is_candidate_fix").select(*NUMBER)
    return lb.introducing_commits(t.n_hunks.join(fixes, "seq"), t.n_blame_runs, "seq", "origin")


def dataset(t):
    """Features of non-merge commits with their label and instant (microseconds)."""
    kept = features(t).where(c("n_parents") <= 1)
    joined = ds.join_labels(kept, targets(t), NUMBER)
    return joined.withColumn("ts", F.unix_micros(fc.to_utc(c("commit_timestamp"))))


def splits(t):
    narrow = dataset(t).select("repo", "full_hash", "seq", "ts", *FEATURES, "bug_introduced")
    return ds.temporal_split(narrow).withColumn("commit_hash", fc.short_hash(c("full_hash")))


# --- sources ---------------------------------------------------------------------------------
@query("s1_null_counts", """SELECT CAST(count(*) FILTER (l_tax IS NULL OR isnan(l_tax)) AS BIGINT) AS l_tax,
  CAST(count(*) FILTER (l_quantity > 40) AS BIGINT) AS q FROM lineitem""")
def s1(t):
    return rd.null_counts(t.lineitem.withColumn("q", F.when(c("l_quantity") <= 40, c("l_quantity"))), ["l_tax", "q"])


@query("s2_change_log", wa(["v_commits"], """SELECT full_hash, substr(full_hash, 1, 7) AS commit_hash, author, commit_timestamp,
  CASE n_parents WHEN 0 THEN '' WHEN 1 THEN 'aa' ELSE 'aa,bb' END AS parents, epoch_us(CAST(commit_timestamp AS TIMESTAMPTZ)) AS ts FROM v_commits"""))
def s2(t):
    line = F.concat_ws("|", "full_hash", "author", "commit_timestamp",
                       F.when(c("n_parents") == 0, "").when(c("n_parents") == 1, "aa").otherwise("aa bb"))
    lines = t.v_commits.select(line.alias("value"))
    junk = t.v_commits.select(F.when(c("seq") % 2 == 0, "").otherwise("broken|line").alias("value"))
    out = rd.parse_change_log(lines.unionByName(junk))
    return out.withColumns({"parents": F.array_join("parents", ","), "ts": F.unix_micros("ts")})


@query("s3_subject_log", wa(["v_commits"], """SELECT full_hash, substr(full_hash, 1, 7) AS commit_hash, author, commit_timestamp, epoch_us(CAST(commit_timestamp AS TIMESTAMPTZ)) AS ts,
  CASE WHEN seq % 3 = 0 THEN concat(subject, '|x') ELSE subject END AS subject,
  CASE n_parents WHEN 0 THEN '' WHEN 1 THEN 'aa' ELSE 'aa,bb' END AS parents FROM v_commits"""))
def s3(t):
    subject = F.when(c("seq") % 3 == 0, F.concat("subject", F.lit("|x"))).otherwise(c("subject"))
    line = F.concat_ws("|", "full_hash", "author", "commit_timestamp", subject,
                       F.when(c("n_parents") == 0, "").when(c("n_parents") == 1, "aa").otherwise("aa bb"))
    out = rd.parse_subject_log(t.v_commits.select(line.alias("value")))
    return out.withColumns({"parents": F.array_join("parents", ","), "ts": F.unix_micros("ts")})


@query("s4_numstat", wa(["v_numstat"], f"SELECT full_hash, num_ord, l_suppkey, l_partkey, path, is_binary, CAST(a AS BIGINT) AS added, CAST(d AS BIGINT) AS deleted FROM f",
  {"f": f"SELECT *, {CLEAN} AS path, (added = '-') AS is_binary, CASE WHEN added = '-' THEN 0 ELSE CAST(added AS BIGINT) END AS a, CASE WHEN added = '-' THEN 0 ELSE CAST(deleted AS BIGINT) END AS d FROM v_numstat"}))
def s4(t):
    keys = ["full_hash", "num_ord", "l_suppkey", "l_partkey"]
    lines = t.v_numstat.select(*keys, F.concat_ws("\t", "added", "deleted", "raw_path").alias("line"))
    junk = t.v_numstat.select(*keys, c("full_hash").alias("line"))
    return ft.parse_counts(rd.parse_numstat(lines.unionByName(junk))).drop("raw_path", "file_churn")


@query("s5_hunk_headers", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, path, old_start, old_count, new_start, new_count FROM (
  SELECT *, concat('f', CAST(l_suppkey AS STRING), '.py') AS path, l_partkey AS old_start, CAST(l_linenumber AS BIGINT) AS old_count, CAST(7 AS BIGINT) AS new_start, CAST(1 AS BIGINT) AS new_count FROM lineitem
  UNION ALL SELECT *, concat('g', CAST(l_suppkey AS STRING), '.py'), CAST(9 AS BIGINT), CAST(1 AS BIGINT), CAST(9 AS BIGINT), CAST(2 AS BIGINT) FROM lineitem) q""")
def s5(t):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    s = lambda x: c(x).cast("string")
    text = F.concat(
        F.lit("diff --git a/x b/x\n--- a/f"), s("l_suppkey"), F.lit(".py\n+++ b/f.py\n@@ -"), s("l_partkey"), F.lit(","),
        s("l_linenumber"), F.lit(" +7 @@ def x():\n-a\n+b\n@@ -5,0 +6,2 @@\n+c\n+d\n--- /dev/null\n+++ b/new.py\n@@ -0,0 +1 @@\n+z\n--- a/g"),
        s("l_suppkey"), F.lit(".py\n+++ b/g.py\n@@ -9 +9,2 @@\n-q\n+r\n+s\n"),
    )
    return rd.parse_hunk_headers(t.lineitem.select(*keys, text.alias("diff_text")))


# --- features --------------------------------------------------------------------------------
@query("a1_commit_features", wa(["v_commits", "v_changes", "v_hunks"], f"SELECT repo, full_hash, commit_hash, {FLIST} FROM feat", P_FEAT))
def a1(t):
    return features(t).select("repo", "full_hash", "commit_hash", *FEATURES)


@query("a2_functions_changed", wa(["v_hunks"], "SELECT repo, full_hash, count(*) AS functions_changed FROM v_hunks GROUP BY repo, full_hash"))
def a2(t):
    return ft.functions_changed(t.v_hunks)


@query("f1_drop_merges", wa(["v_commits"], "SELECT repo, full_hash, seq FROM v_commits WHERE n_parents <= 1"))
def f1(t):
    return ft.drop_merges(commits(t)).select("repo", "full_hash", "seq")


@query("f3_latest_n", wa(["v_commits"], """SELECT repo, full_hash, seq, row_number() OVER (PARTITION BY repo ORDER BY seq) AS ordinal FROM (
 SELECT *, row_number() OVER (PARTITION BY repo ORDER BY seq DESC) AS back FROM v_commits) q WHERE back <= 25"""))
def f3(t):
    return ft.latest_n(t.v_commits.select("repo", "full_hash", "seq"), 25)


@query("f5_scorable", wa(["v_commits", "v_changes", "v_hunks"], """SELECT repo, full_hash, CASE WHEN n_parents > 1 THEN 'merge_commit' WHEN files_changed = 0 THEN 'empty_commit' END AS skip_reason FROM feat""", P_FEAT))
def f5(t):
    rows = features(t).withColumn("parents", F.array_repeat(F.lit("p"), c("n_parents")))
    return ft.scorable(rows).select("repo", "full_hash", "skip_reason")


@query("f8_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def f8(t):
    return ds.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("a19_log_audit", wa(["v_commits", "v_changes", "v_hunks"], """SELECT repo, count(*) AS commits, CAST(count_if(code_churn = 0) AS BIGINT) AS zero_churn,
 CAST(count_if(is_test_file_modified = 1) AS BIGINT) AS test_touching, CAST(count_if(num_directories_touched > 1) AS BIGINT) AS multi_directory FROM feat GROUP BY repo""", P_FEAT))
def a19(t):
    return ft.log_audit(features(t))


# --- labels ----------------------------------------------------------------------------------
@query("f4_candidate_fixes", wa(["v_commits", "v_changes"], """SELECT s.repo, s.full_hash, issue_ids, is_revert, coalesce(n, 0) AS files_changed_count FROM signals s
 LEFT JOIN (SELECT repo, full_hash, count(*) AS n FROM v_changes GROUP BY ALL) f ON f.repo = s.repo AND f.full_hash = s.full_hash
 WHERE (has_fix_keyword OR has_issue_id) AND NOT is_cosmetic""", {"signals": SIGNALS}))
def f4(t):
    out = lb.fix_candidates(t.v_commits, t.v_changes).where("is_candidate_fix")
    return out.select("repo", "full_hash", F.array_join("issue_ids", ",").alias("issue_ids"), "is_revert", "files_changed_count")


@query("j3_hunk_origins", wa(["v_hunks", "v_blame_runs"], ORIGINS))
def j3(t):
    return lb.hunk_origins(t.v_hunks, t.v_blame_runs)


@query("a3_szz_evidence", wa(V_ALL, "SELECT repo, intro_hash, fixing_commits, fixing_issues, rnk, is_revert, traced_lines_count FROM summary", P_EVID))
def a3(t):
    out = lb.evidence_summary(evidence(t)).withColumnRenamed("rank", "rnk")
    return out.withColumns({k: F.array_join(k, ",") for k in ("fixing_commits", "fixing_issues")})


@query("j4_labels", wa(V_ALL, "SELECT * FROM labels", P_LABEL))
def j4(t):
    out = labels(t).drop("commit_hash")
    return out.withColumns({k: F.array_join(k, ",") for k in ("fixing_commits", "fixing_issues")})


@query("a18_label_audit", wa(V_ALL, """SELECT 'label_confidence' AS section, label_confidence AS name, count(*) AS n FROM labels GROUP BY ALL
 UNION ALL SELECT 'label_source', label_source, count(*) FROM labels GROUP BY ALL
 UNION ALL SELECT 'totals', 'fix_linkages', CAST(sum(k) AS BIGINT) FROM (SELECT count(DISTINCT substr(fix_hash, 1, 7)) AS k FROM evidence GROUP BY repo, intro_hash) a
 UNION ALL SELECT 'totals', 'multi_fix_commits', CAST(count_if(k > 1) AS BIGINT) FROM (SELECT count(DISTINCT substr(fix_hash, 1, 7)) AS k FROM evidence GROUP BY repo, intro_hash) b
 UNION ALL SELECT 'totals', 'issue_ids', count(*) FROM (SELECT DISTINCT repo, unnest(string_split(issue_id, ',')) FROM evidence WHERE issue_id <> '') d""", P_LABEL))
def a18(t):
    return lb.label_audit(evidence(t), labels(t))


# --- dataset ---------------------------------------------------------------------------------
@query("j1_dataset", wa(V_ALL, f"SELECT repo, full_hash, ts, {FLIST}, bug_introduced FROM dataset", P_DATA))
def j1(t):
    return dataset(t).select("repo", "full_hash", "ts", *FEATURES, "bug_introduced")


@query("j2_join_coverage", wa(V_ALL, """SELECT CAST(count_if(l.full_hash IS NULL) AS BIGINT) AS features_only, CAST(count_if(f.full_hash IS NULL) AS BIGINT) AS labels_only,
 CAST(count_if(f.full_hash IS NOT NULL AND l.full_hash IS NOT NULL) AS BIGINT) AS matched
 FROM (SELECT * FROM feat WHERE n_parents <= 1) f FULL JOIN labels l ON f.repo = l.repo AND f.full_hash = l.full_hash""", {**P_FEAT, **P_LABEL}))
def j2(t):
    return ds.join_coverage(features(t).where(c("n_parents") <= 1), labels(t))


@query("a5_quality_report", wa(V_ALL, f"""SELECT count(*) AS total_rows, {", ".join(f"CAST(count_if({f} IS NULL) AS BIGINT) AS null_{f}" for f in FEATURES)},
 CAST(count_if(code_churn <> lines_added + lines_deleted) AS BIGINT) AS churn_mismatches, CAST(count_if(bug_introduced NOT IN (0, 1)) AS BIGINT) AS invalid_targets,
 CAST(count_if(bug_introduced = 1) AS BIGINT) AS label_1_count, CAST(count_if(bug_introduced = 0) AS BIGINT) AS label_0_count,
 (CAST(printf('%.2f', CAST(count_if(bug_introduced = 1) AS DOUBLE) * 100.0::DOUBLE / count(*)) AS DOUBLE) + 0.0::DOUBLE) AS percentage_label_1, CAST(count_if(ts IS NULL) AS BIGINT) AS null_timestamps, min(ts) AS min_timestamp, max(ts) AS max_timestamp,
 '' AS leaked_columns, '' AS non_numeric_features FROM dataset""", P_DATA))
def a5(t):
    return ds.quality_report(dataset(t))


@query("w1_temporal_split", wa(V_ALL, "SELECT repo, full_hash, pos AS position, split FROM splits", P_SPLIT))
def w1(t):
    return splits(t).select("repo", "full_hash", "position", "split")


# Rows that repeat, a null repository and rows without an instant; equal rows are counted, because they are interchangeable.
REPEATED = """SELECT CASE WHEN l_returnflag <> 'R' THEN l_returnflag END AS repo, CASE WHEN l_partkey % 50 <> 7 THEN CAST(l_shipdate AS DATE) END AS ts, l_suppkey % 5 AS seq, CAST(l_linenumber AS VARCHAR) AS full_hash FROM lineitem"""


@query("w1_split_repeated_rows", f"""SELECT repo, ts, seq, full_hash, split, count(*) AS rows FROM (
 SELECT *, CASE WHEN ts IS NULL THEN 'undated' WHEN pos <= a THEN 'train' WHEN pos <= a + b THEN 'validation' ELSE 'test' END AS split FROM (
  SELECT *, CAST(round_even(n * 0.7::DOUBLE, 0) AS BIGINT) AS a, CAST(round_even(n * 0.15::DOUBLE, 0) AS BIGINT) AS b FROM (
   SELECT *, row_number() OVER (PARTITION BY repo, ts IS NULL ORDER BY ts, seq, full_hash) AS pos, count(*) OVER (PARTITION BY repo, ts IS NULL) AS n FROM ({REPEATED}) r) q) p) s GROUP BY ALL""")
def w1_repeated(t):
    rows = t.lineitem.select(
        F.when(c("l_returnflag") != "R", c("l_returnflag")).alias("repo"), F.when(c("l_partkey") % 50 != 7, c("l_shipdate").cast("date")).alias("ts"),
        (c("l_suppkey") % 5).alias("seq"), c("l_linenumber").cast("string").alias("full_hash"),
    )
    return ds.temporal_split(rows).groupBy("repo", "ts", "seq", "full_hash", "split").agg(F.count("*").alias("rows"))


@query("w3_split_unlabelled_rows", """SELECT y, CASE WHEN pos <= CAST(round_even(n * 0.2::DOUBLE, 0) AS BIGINT) THEN 'test' ELSE 'train' END AS split, count(*) AS rows, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM (
 SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(concat_ws('|', '42', l_orderkey, l_linenumber)), l_orderkey, l_linenumber) AS pos, count(*) OVER (PARTITION BY y) AS n FROM (
  SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END AS y FROM lineitem) a) b GROUP BY ALL""")
def w3_unlabelled(t):
    y = F.when(c("l_returnflag") == "R", 1).when(c("l_returnflag") == "A", 0)
    out = ds.stratified_split(t.lineitem.select("l_orderkey", "l_linenumber", y.alias("y")), ["l_orderkey", "l_linenumber"], label="y")
    return out.groupBy("y", "split").agg(F.count("*").alias("rows"), F.sum("l_orderkey").alias("keys"))


@query("w2_is_chronological", wa(["v_commits"], """SELECT repo, count(*) AS rows, CAST(count_if(ts < prev) AS BIGINT) AS falls, count_if(ts < prev) = 0 AS is_chronological FROM (
 SELECT *, lag(ts) OVER (PARTITION BY repo ORDER BY seq, full_hash) AS prev FROM (SELECT *, epoch_us(CAST(commit_timestamp AS TIMESTAMPTZ)) AS ts FROM v_commits) a) b GROUP BY repo"""))
def w2(t):
    return ds.is_chronological(t.v_commits.withColumn("ts", F.unix_micros(fc.to_utc(c("commit_timestamp")))))


@query("w3_stratified_split", wa(V_ALL, """SELECT repo, full_hash, bug_introduced, CASE WHEN pos <= CAST(round_even(n * 0.2::DOUBLE, 0) AS BIGINT) THEN 'test' ELSE 'train' END AS split FROM (
 SELECT *, row_number() OVER (PARTITION BY bug_introduced ORDER BY md5(concat_ws('|', '42', repo, full_hash)), repo, full_hash) AS pos, count(*) OVER (PARTITION BY bug_introduced) AS n FROM labels) q""", P_LABEL))
def w3(t):
    rows = labels(t).select("repo", "full_hash", "bug_introduced")
    return ds.stratified_split(rows, ["repo", "full_hash"])


OVERLAP = """SELECT repo, CAST(count_if(a AND b) AS BIGINT) AS train_validation, CAST(count_if(b AND d) AS BIGINT) AS validation_test, CAST(count_if(a AND d) AS BIGINT) AS train_test,
 CAST(count_if(a AND b) + count_if(b AND d) + count_if(a AND d) AS BIGINT) AS total_overlap FROM (
 SELECT repo, full_hash, bool_or(split = 'train') AS a, bool_or(split = 'validation') AS b, bool_or(split = 'test') AS d FROM dup GROUP BY repo, full_hash) q GROUP BY repo"""


@query("j5_split_overlap", wa(["v_commits"], OVERLAP, {"dup": """SELECT repo, full_hash, CASE seq % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split FROM v_commits
 UNION ALL SELECT repo, full_hash, CASE seq % 5 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END FROM v_commits"""}))
def j5(t):
    def tag(n):
        k = c("seq") % n
        return t.v_commits.select("repo", "full_hash", F.when(k == 0, "train").when(k == 1, "validation").otherwise("test").alias("split"))

    return ds.split_overlap(tag(3).unionByName(tag(5)))


@query("a4_class_distribution", wa(V_ALL, """SELECT repo, split, count(*) AS total_rows, CAST(count_if(bug_introduced = 1) AS BIGINT) AS positive_count, CAST(count_if(bug_introduced = 0) AS BIGINT) AS negative_count,
 (CAST(printf('%.2f', CAST(count_if(bug_introduced = 1) AS DOUBLE) * 100.0::DOUBLE / count(*)) AS DOUBLE) + 0.0::DOUBLE) AS positive_pct, (CAST(printf('%.2f', CAST(count_if(bug_introduced = 0) AS DOUBLE) * 100.0::DOUBLE / count(*)) AS DOUBLE) + 0.0::DOUBLE) AS negative_pct
 FROM splits GROUP BY repo, split""", P_SPLIT))
def a4(t):
    return ds.class_distribution(splits(t), ["repo", "split"])


@query("a6_split_report", wa(V_ALL, """SELECT repo, count(*) AS total_rows, CAST(count_if(split = 'train') AS BIGINT) AS train_rows, CAST(count_if(split = 'validation') AS BIGINT) AS validation_rows,
 CAST(count_if(split = 'test') AS BIGINT) AS test_rows, CAST(count_if(split = 'test' AND bug_introduced = 1) AS BIGINT) AS test_positives, CAST(count_if(split = 'test' AND bug_introduced = 0) AS BIGINT) AS test_negatives,
 CAST(0 AS BIGINT) AS total_overlap, true AS checksum_valid, max(ts) FILTER (split = 'train') <= min(ts) FILTER (split = 'validation') AS train_to_validation_ordered,
 max(ts) FILTER (split = 'validation') <= min(ts) FILTER (split = 'test') AS validation_to_test_ordered,
 count_if(split = 'test' AND bug_introduced = 1) > 0 AND count_if(split = 'test' AND bug_introduced = 0) > 0 AS test_has_both_classes FROM splits GROUP BY repo""", P_SPLIT))
def a6(t):
    return ds.split_report(splits(t))


# --- statistics ------------------------------------------------------------------------------
def _long(parts: str, keys: str, source: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{f}' AS feature, {parts.replace('{f}', f)} FROM {source} GROUP BY {keys}" for f in FEATURES)


STATS_SQL = _long(
    "CAST(min({f}) AS DOUBLE) AS min, CAST(max({f}) AS DOUBLE) AS max, (CAST(printf('%.4f', avg(CAST({f} AS DOUBLE))) AS DOUBLE) + 0.0::DOUBLE) AS mean, (CAST(printf('%.4f', median(CAST({f} AS DOUBLE))) AS DOUBLE) + 0.0::DOUBLE) AS median, (CAST(printf('%.4f', stddev_samp(CAST({f} AS DOUBLE))) AS DOUBLE) + 0.0::DOUBLE) AS std",
    "split", "splits")
SCALER = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, avg(CAST({f} AS DOUBLE)) AS mean, CASE WHEN stddev_pop(CAST({f} AS DOUBLE)) = 0 THEN 1.0::DOUBLE ELSE stddev_pop(CAST({f} AS DOUBLE)) END AS scale FROM splits WHERE split = 'train'" for f in FEATURES)
Z = ", ".join(f"(CAST({f} AS DOUBLE) - (SELECT mean FROM scaler WHERE feature = '{f}')) / (SELECT scale FROM scaler WHERE feature = '{f}') AS {f}" for f in FEATURES)


@query("a7_descriptive_stats", wa(V_ALL, STATS_SQL, P_SPLIT))
def a7(t):
    return st.descriptive_stats(splits(t), ["split"])


@query("a9_strong_pairs", wa(V_ALL, " UNION ALL ".join(
    f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, (CAST(printf('%.4f', corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))) AS DOUBLE) + 0.0::DOUBLE) AS correlation FROM splits WHERE split = 'train' HAVING abs(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))) >= 0.7"
    for a, b in combinations(FEATURES, 2)), P_SPLIT))
def a9(t):
    return st.strong_pairs(splits(t).where(c("split") == "train"))


@query("a10_scaler_fit", wa(V_ALL, "SELECT feature, round(mean, 6) AS mean, round(scale, 6) AS scale FROM scaler", {**P_SPLIT, "scaler": SCALER}))
def a10(t):
    fitted = st.fit_scaler(splits(t).where(c("split") == "train"))
    return fitted.select("feature", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


def scaled(t):
    parts = splits(t)
    return st.standardize(parts, st.scaler_values(parts.where(c("split") == "train")))


@query("m2_standardize", wa(V_ALL, f"SELECT repo, full_hash, {', '.join(f'round({f}, 6) AS {f}' for f in FEATURES)} FROM (SELECT repo, full_hash, {Z} FROM splits) q", {**P_SPLIT, "scaler": SCALER}))
def m2(t):
    return scaled(t).select("repo", "full_hash", *[F.round(f"{f}_z", 6).alias(f) for f in FEATURES])


@query("a8_scaled_stats", wa(V_ALL, _long("round(avg({f}), 4) AS mean, round(stddev_pop({f}), 4) AS std, round(min({f}), 4) AS min, round(max({f}), 4) AS max", "split", "z"),
  {**P_SPLIT, "scaler": SCALER, "z": f"SELECT split, {Z} FROM splits"}))
def a8(t):
    out = st.scaled_stats(scaled(t), ["split"])
    return out.withColumns({"feature": F.regexp_replace("feature", "_z$", ""), **{k: c(k) + 0.0 for k in ("mean", "std", "min", "max")}})
