"""Queries of the scalar expressions (section P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from changerisk.functions import commits as fc, paths as fp, scoring as fs, text as ft
from changerisk.functions.rounding import round_exact
from changerisk.operators import evaluation as ev
from changerisk.plans.adapters import with_adapters as wa
from changerisk.plans.catalog import query

c = F.col

# --- paths -----------------------------------------------------------------------------------
CLEAN = """CASE WHEN NOT contains(raw_path, '=>') THEN trim(raw_path)
 ELSE trim(replace(CASE WHEN regexp_matches(raw_path, '\\{.*=>.*\\}')
   THEN regexp_replace(raw_path, '^(.*?)\\{.*?=>\\s*(.*?)\\}(.*)$', '\\1\\2\\3')
   ELSE regexp_replace(raw_path, '^.*?=>\\s*(.*)$', '\\1') END, '//', '/')) END"""
IDS = "seq, num_ord, l_partkey, l_suppkey"
PATHS = {"p": f"SELECT seq, num_ord, l_partkey, l_suppkey, {CLEAN} AS path FROM v_numstat"}
TEST_RE = "(?i)test_|_test\\.|/tests?/|/spec/|Test\\.java$|Spec\\."
GEN_RE = (
    "(?i)package-lock\\.json$|yarn\\.lock$|pnpm-lock\\.yaml$|cargo\\.lock$|Gemfile\\.lock$|"
    "\\.min\\.js$|\\.min\\.css$|\\.map$|\\.generated\\.|\\.pb\\.go$|swagger\\.json$"
)
EXT_LIST = ", ".join(f"'{e}'" for e in fp.SOURCE_EXTENSIONS)
EXT = "lower(regexp_extract(path, '[^./][^/]*(\\.[^./]*)$', 1))"
DIR = "coalesce(nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), ''), '.')"


def _paths(t):
    return t.v_numstat.select(
        "seq", "num_ord", "l_partkey", "l_suppkey", fp.clean_rename_path(c("raw_path")).alias("path")
    )


@query("p1_clean_rename_path", wa(["v_numstat"], "SELECT * FROM p", PATHS))
def p1(t):
    return _paths(t)


@query("p2_directory_of", wa(["v_numstat"], f"SELECT {IDS}, {DIR} AS directory FROM p", PATHS))
def p2(t):
    return _paths(t).withColumn("directory", fp.directory_of(c("path"))).drop("path")


@query("p3_is_source_file", wa(["v_numstat"], f"SELECT {IDS}, {EXT} AS extension, {EXT} IN ({EXT_LIST}) AS is_source FROM p", PATHS))
def p3(t):
    return _paths(t).select(
        "seq", "num_ord", "l_partkey", "l_suppkey", fp.extension_of(c("path")).alias("extension"),
        fp.is_source_file(c("path")).alias("is_source"),
    )


@query("p4_is_test_file", wa(["v_numstat"], f"SELECT {IDS}, regexp_matches(path, '{TEST_RE}') AS is_test FROM p", PATHS))
def p4(t):
    return _paths(t).withColumn("is_test", fp.is_test_file(c("path"))).drop("path")


@query("p5_is_generated_file", wa(["v_numstat"], f"SELECT {IDS}, regexp_matches(replace(trim(path), chr(92), '/'), '{GEN_RE}') AS is_generated FROM p", PATHS))
def p5(t):
    return _paths(t).withColumn("is_generated", fp.is_generated_file(c("path"))).drop("path")


@query("p6_churn", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, a + d AS file_churn,
  (CAST(printf('%.2f', CAST(a + d AS DOUBLE) / greatest(1, l_linenumber)) AS DOUBLE) + 0.0::DOUBLE) AS avg_lines FROM (
  SELECT *, CAST(l_quantity AS BIGINT) AS a, CAST(round(l_discount * 100) AS BIGINT) AS d FROM lineitem) q""")
def p6(t):
    a = c("l_quantity").cast("bigint")
    d = F.round(c("l_discount") * 100).cast("bigint")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (a + d).alias("file_churn"),
        fc.avg_lines(a + d, c("l_linenumber")).alias("avg_lines"),
    )


# --- commit subjects -------------------------------------------------------------------------
FIX_RE = f"(?i)\\b({fc.FIX_WORDS})\\b"
COS_RE = f"(?i)\\b({fc.COSMETIC_WORDS})\\b"
ID_RE = "(?i)\\b(GH-\\d+|JIRA-\\d+|#\\d+|issue\\s*#?\\d+)\\b"
REV_RE = "(?i)^(Revert\\s+|\\b(revert|reverted|reverting)\\b)"
SIGNALS = f"""SELECT repo, full_hash, seq, subject, regexp_matches(subject, '{FIX_RE}') AS has_fix_keyword,
 regexp_matches(subject, '{ID_RE}') AS has_issue_id, regexp_matches(subject, '{REV_RE}') AS is_revert,
 regexp_matches(subject, '{COS_RE}') AS is_cosmetic,
 array_to_string(list_sort(list_distinct(regexp_extract_all(subject, '{ID_RE}', 1))), ',') AS issue_ids
 FROM v_commits"""


@query("p7_short_hash", wa(["v_commits"], "SELECT repo, full_hash, substr(full_hash, 1, 7) AS commit_hash FROM v_commits"))
def p7(t):
    return t.v_commits.select("repo", "full_hash", fc.short_hash(c("full_hash")).alias("commit_hash"))


@query("p8_fix_signals", wa(["v_commits"], "SELECT repo, full_hash, has_fix_keyword, has_issue_id, is_revert, is_cosmetic FROM s", {"s": SIGNALS}))
def p8(t):
    return t.v_commits.select("repo", "full_hash", *[v.alias(k) for k, v in fc.fix_signals(c("subject")).items()])


@query("p9_issue_ids", wa(["v_commits"], "SELECT repo, full_hash, issue_ids FROM s", {"s": SIGNALS}))
def p9(t):
    return t.v_commits.select("repo", "full_hash", F.array_join(fc.issue_ids(c("subject")), ",").alias("issue_ids"))


CONF = "CASE WHEN has_issue_id AND has_fix_keyword THEN 'HIGH' WHEN has_issue_id OR has_fix_keyword THEN 'MEDIUM' ELSE 'LOW' END"


@query("p10_fix_confidence", wa(["v_commits"], f"SELECT repo, full_hash, {CONF} AS confidence FROM s", {"s": SIGNALS}))
def p10(t):
    s = c("subject")
    return t.v_commits.select("repo", "full_hash", fc.fix_confidence(fc.has_issue_id(s), fc.has_fix_keyword(s)).alias("confidence"))


@query("p11_label_texts", wa(["v_commits"], f"""SELECT repo, full_hash,
 CASE WHEN NOT has_fix_keyword THEN 'unlabeled_no_evidence' WHEN is_revert THEN 'revert_trace' ELSE 'szz_blame_traced' END AS label_source,
 CASE WHEN has_fix_keyword THEN '{fc.SEMANTICS_TRACED}' ELSE '{fc.SEMANTICS_NONE}' END AS label_semantics FROM s""", {"s": SIGNALS}))
def p11(t):
    s = c("subject")
    labeled = fc.has_fix_keyword(s)
    return t.v_commits.select(
        "repo", "full_hash", fc.label_source(F.when(labeled, fc.is_revert(s))).alias("label_source"),
        fc.label_semantics(labeled).alias("label_semantics"),
    )


@query("p12_to_utc", wa(["v_commits"], "SELECT repo, full_hash, epoch_us(CAST(commit_timestamp AS TIMESTAMPTZ)) AS instant_us FROM v_commits"))
def p12(t):
    return t.v_commits.select("repo", "full_hash", F.unix_micros(fc.to_utc(c("commit_timestamp"))).alias("instant_us"))


# --- scores ----------------------------------------------------------------------------------
SID = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
sid = SID.split(", ")


@query("p13_risk_level", wa(["v_scored"], f"SELECT {SID}, CASE WHEN p < 0.35::DOUBLE THEN 'LOW' WHEN p < 0.6::DOUBLE THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level FROM v_scored"))
def p13(t):
    return t.v_scored.select(*sid, fs.risk_level(c("p")).alias("risk_level"))


@query("p14_risk_level_legacy", wa(["v_scored"], f"SELECT {SID}, CASE WHEN p < 0.33::DOUBLE THEN 'LOW' WHEN p < 0.66::DOUBLE THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level, CASE WHEN p >= 0.5 THEN 'Bug-prone' ELSE 'Clean' END AS prediction_label FROM v_scored"))
def p14(t):
    return t.v_scored.select(*sid, fs.risk_level(c("p"), fs.LEGACY_BANDS).alias("risk_level"), fs.legacy_label(c("p")).alias("prediction_label"))


@query("p15_decision", wa(["v_scored"], f"SELECT {SID}, p >= 0.35::DOUBLE AS is_above, CASE WHEN p >= 0.35::DOUBLE THEN '{fs.LABEL_ABOVE}' ELSE '{fs.LABEL_BELOW}' END AS prediction_label FROM v_scored"))
def p15(t):
    above = fs.is_above(c("p"), 0.35)
    return t.v_scored.select(*sid, above.alias("is_above"), fs.decision_label(above).alias("prediction_label"))


@query("p16_impute_features", f"""
WITH b AS (SELECT {SID}, CAST(l_quantity AS BIGINT) AS lines_added, CAST(round(l_tax * 100) AS BIGINT) AS lines_deleted,
  CAST(l_linenumber - 1 AS BIGINT) AS files_changed,
  CASE WHEN l_partkey % 2 = 0 THEN CAST(l_quantity AS BIGINT) END AS given_churn FROM lineitem),
d AS (SELECT *, coalesce(given_churn, lines_added + lines_deleted) AS code_churn FROM b),
e AS (SELECT *, (CAST(printf('%.2f', CAST(code_churn AS DOUBLE) / greatest(1, files_changed)) AS DOUBLE) + 0.0::DOUBLE) AS avg_lines FROM d)
SELECT {SID}, code_churn, avg_lines AS avg_lines_changed_per_file,
  CAST(floor(greatest(avg_lines, CAST(code_churn AS DOUBLE) * 0.7::DOUBLE)) AS BIGINT) AS max_lines_changed_in_single_file,
  greatest(1, files_changed) AS num_source_files_changed, CAST(1 AS BIGINT) AS num_directories_touched,
  CAST(0 AS BIGINT) AS is_test_file_modified FROM e""")
def p16(t):
    none = F.lit(None).cast("bigint")
    base = t.lineitem.select(
        *sid,
        c("l_quantity").cast("bigint").alias("lines_added"),
        F.round(c("l_tax") * 100).cast("bigint").alias("lines_deleted"),
        (c("l_linenumber") - 1).cast("bigint").alias("files_changed"),
        F.when(c("l_partkey") % 2 == 0, c("l_quantity").cast("bigint")).alias("code_churn"),
        F.lit(None).cast("double").alias("avg_lines_changed_per_file"),
        none.alias("max_lines_changed_in_single_file"), none.alias("num_source_files_changed"),
        none.alias("num_directories_touched"), none.alias("is_test_file_modified"),
    )
    filled = fc.impute_features()
    return base.withColumns(filled).select(*sid, *filled)


ERR = "CASE WHEN y = 1 AND p >= 0.35::DOUBLE THEN 'TP' WHEN y = 0 AND p < 0.35::DOUBLE THEN 'TN' WHEN p >= 0.35::DOUBLE THEN 'FP' ELSE 'FN' END"


@query("p17_error_type", wa(["v_scored"], f"SELECT {SID}, {ERR} AS error_type FROM v_scored"))
def p17(t):
    return ev.error_rows(t.v_scored).select(*sid, "error_type")


@query("p19_finite_vector", f"""SELECT {SID}, NOT (x IS NULL OR isnan(x) OR isinf(x)) AS usable FROM (
 SELECT *, CASE l_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'NaN'::DOUBLE WHEN 2 THEN '-Infinity'::DOUBLE ELSE l_tax END AS x FROM lineitem) q""")
def p19(t):
    k = c("l_partkey") % 9
    x = F.when(k == 0, None).when(k == 1, float("nan")).when(k == 2, float("-inf")).otherwise(c("l_tax"))
    return t.lineitem.withColumn("x", x).select(*sid, fs.is_finite_vector([c("x"), c("l_quantity")]).alias("usable"))


@query("p29_signal_direction", f"""SELECT {SID}, abs(v) AS abs_contribution,
 CASE WHEN v > 0 THEN 'Positive' WHEN v < 0 THEN 'Negative' ELSE 'Neutral' END AS direction,
 CASE WHEN v > 0 THEN 'Increases Risk' WHEN v < 0 THEN 'Decreases Risk' ELSE 'Neutral' END AS impact
 FROM (SELECT *, l_discount - 0.05::DOUBLE AS v FROM lineitem) q""")
def p29(t):
    parts = fs.signal_direction(c("v"))
    return t.lineitem.withColumn("v", c("l_discount") - 0.05).select(*sid, *[x.alias(k) for k, x in parts.items()])


# --- texts -----------------------------------------------------------------------------------
RANGE_RE = "(?i)^\\s*L?(\\d+)(?:\\s*-\\s*L?(\\d+))?\\s*$"


@query("p20_parse_line_range", wa(["v_citations"], f"""SELECT event_id, regexp_matches(line_range, '{RANGE_RE}') AS range_valid,
  least(a, coalesce(b, a)) AS range_start, greatest(a, coalesce(b, a)) AS range_end FROM (
  SELECT *, TRY_CAST(regexp_extract(line_range, '{RANGE_RE}', 1) AS BIGINT) AS a,
            TRY_CAST(regexp_extract(line_range, '{RANGE_RE}', 2) AS BIGINT) AS b FROM v_citations) q"""))
def p20(t):
    return t.v_citations.select("event_id", *[v.alias(k) for k, v in ft.parse_line_range(c("line_range")).items()])


@query("p21_strip_code_fence", """
WITH s AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat('```json\n', text, '\n```') WHEN 1 THEN concat('```\n', text, '```')
   WHEN 2 THEN concat('```python\n', text, '\n```\n') WHEN 3 THEN concat('```\n', text) ELSE text END AS t FROM documents),
 u AS (SELECT doc_id, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS t FROM s),
 w AS (SELECT doc_id, t, string_split(t, chr(10)) AS l FROM u)
SELECT doc_id, CASE WHEN regexp_matches(t, '(?is)^```(?:json)?\\s*\\n?(.*?)\\n?```$')
    THEN regexp_replace(regexp_extract(t, '(?is)^```(?:json)?\\s*\\n?(.*?)\\n?```$', 1), '^\\s+|\\s+$', '', 'g')
  WHEN starts_with(t, '```') THEN regexp_replace(array_to_string(CASE WHEN trim(l[-1]) = '```' AND len(l) > 1 THEN l[2:len(l) - 1] ELSE l[2:] END, chr(10)), '^\\s+|\\s+$', '', 'g')
  ELSE t END AS body FROM w""")
def p21(t):
    k = c("doc_id") % 5
    made = (
        F.when(k == 0, F.concat(F.lit("```json\n"), "text", F.lit("\n```")))
        .when(k == 1, F.concat(F.lit("```\n"), "text", F.lit("```")))
        .when(k == 2, F.concat(F.lit("```python\n"), "text", F.lit("\n```\n")))
        .when(k == 3, F.concat(F.lit("```\n"), "text"))
        .otherwise(c("text"))
    )
    return t.documents.select("doc_id", ft.strip_code_fence(made).alias("body"))


def _redact_sql(x: str) -> str:
    for pattern, replacement in ft.REDACTIONS:
        x = f"regexp_replace({x}, '{pattern}', '{replacement}', 'g')"
    return x


@query("p22_redact", wa(["v_text"], f"""SELECT doc_id, {_redact_sql('text')} AS redacted,
 regexp_replace(regexp_replace(CASE WHEN contains(text, 'Authorization') THEN regexp_replace(split_part(text, 'Authorization', 1), '^\\s+|\\s+$', '', 'g') ELSE text END,
   '{ft.BEARER[0]}', '{ft.BEARER[1]}', 'g'), '^\\s+|\\s+$', '', 'g') AS no_header FROM v_text"""))
def p22(t):
    return t.v_text.select("doc_id", ft.redact(c("text")).alias("redacted"), ft.redact_header(c("text")).alias("no_header"))


URL_RE = "(?i)^(?:https?://)?(?:www\\.)?github\\.com/([a-zA-Z0-9_.-]+)/([a-zA-Z0-9_.-]+)/pull/(\\d+)(?:[/?#].*)?$"
NAME_RE = "^([a-zA-Z0-9_.-]+)/([a-zA-Z0-9_.-]+)$"


@query("p23_parse_pr_reference", wa(["v_citations"], f"""
SELECT event_id, reject_reason,
  CASE WHEN reject_reason IS NULL THEN CASE WHEN u THEN regexp_extract(r, '{URL_RE}', 1) ELSE regexp_extract(r, '{NAME_RE}', 1) END END AS owner,
  CASE WHEN reject_reason IS NULL THEN CASE WHEN u THEN regexp_extract(r, '{URL_RE}', 2) ELSE regexp_extract(r, '{NAME_RE}', 2) END END AS repository,
  CASE WHEN reject_reason IS NULL THEN CASE WHEN u THEN CAST(regexp_extract(r, '{URL_RE}', 3) AS BIGINT) ELSE n END END AS number
FROM (SELECT *, CASE WHEN r = '' THEN 'empty' WHEN u THEN NULL WHEN NOT regexp_matches(r, '{NAME_RE}') THEN 'invalid_repository'
        WHEN pr_number IS NULL THEN 'missing_number' WHEN n IS NULL THEN 'invalid_number' WHEN n <= 0 THEN 'non_positive_number' END AS reject_reason
  FROM (SELECT event_id, trim(pr_ref) AS r, regexp_matches(trim(pr_ref), '{URL_RE}') AS u, pr_number, TRY_CAST(pr_number AS BIGINT) AS n FROM v_citations) a) b"""))
def p23(t):
    return t.v_citations.select("event_id", *[v.alias(k) for k, v in ft.parse_pr_reference(c("pr_ref"), c("pr_number")).items()])


@query("p24_valid_names", wa(["v_citations"], """SELECT event_id, regexp_matches(md5(ref) || substr(md5(pr_ref), 1, CASE WHEN event_id % 3 = 0 THEN 8 ELSE 7 END), '^[0-9a-fA-F]{40}$') AS valid_sha,
 regexp_matches(ref, '^[a-zA-Z0-9_.-]+$') AS valid_name FROM v_citations"""))
def p24(t):
    sha = F.concat(F.md5("ref"), F.substr(F.md5("pr_ref"), F.lit(1), F.when(c("event_id") % 3 == 0, 8).otherwise(7)))
    return t.v_citations.select("event_id", fc.valid_sha1(sha).alias("valid_sha"), fc.valid_repo_name(c("ref")).alias("valid_name"))


BANNED = " ".join(
    f"WHEN contains(r, {'chr(92)' if b == chr(92) else repr(b)}) THEN concat('prohibited_sequence ', {'chr(92)' if b == chr(92) else repr(b)})"
    for b in fc.BANNED_IN_REF
)


@query("p25_valid_git_ref", wa(["v_citations"], f"""SELECT event_id, CASE WHEN r = '' THEN 'empty' WHEN starts_with(r, '-') THEN 'leading_hyphen'
 WHEN regexp_matches(r, '[\\s\\x00-\\x1f\\x7f]') THEN 'whitespace_or_control' {BANNED} WHEN regexp_matches(r, '[/.]$') THEN 'bad_ending' END AS reject_reason
 FROM (SELECT event_id, trim(ref) AS r FROM v_citations) q"""))
def p25(t):
    return t.v_citations.select("event_id", fc.ref_reject_reason(c("ref")).alias("reject_reason"))


@query("p26_display", wa(["v_commits"], """
SELECT seq, trim(split_part(author, '<', 1)) AS author_short,
  CASE WHEN length(m) > 60 THEN concat(substr(m, 1, 57), '...') ELSE m END AS message_short,
  CASE WHEN lv = 'X' THEN 'UNKNOWN' ELSE lv END AS norm_level,
  CASE lv WHEN 'HIGH' THEN 'red' WHEN 'MEDIUM' THEN 'amber' WHEN 'LOW' THEN 'green' ELSE 'gray' END AS color,
  concat(icon, ' ', CASE WHEN lv = 'X' THEN 'UNKNOWN' ELSE lv END) AS badge_text,
  CASE WHEN above THEN 'Elevated Defect Risk' ELSE 'Standard Risk Change' END AS label,
  CASE WHEN above THEN 'Above Threshold (>= 0.35)' ELSE 'Below Threshold (< 0.35)' END AS threshold_status, icon
FROM (SELECT *, CASE WHEN lv = 'X' THEN 'ℹ️' WHEN lv = 'LOW' THEN CASE WHEN above THEN '⚠️' ELSE '✅' END
        WHEN above THEN '⚠️' ELSE 'ℹ️' END AS icon FROM (
  SELECT seq, author, trim(concat(subject, ' ', CASE WHEN seq % 2 = 0 THEN 'and a good deal more of the same text to be cut' ELSE '' END)) AS m,
    CASE seq % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' ELSE 'X' END AS lv, seq % 3 = 0 AS above FROM v_commits) a) b"""))
def p26(t):
    k = c("seq") % 4
    level = F.when(k == 0, " high ").when(k == 1, "MEDIUM").when(k == 2, "low").otherwise("weird")
    long = F.concat_ws(" ", "subject", F.when(c("seq") % 2 == 0, "and a good deal more of the same text to be cut").otherwise(""))
    two_lines = F.concat(long, F.lit("\nsecond line"))
    return t.v_commits.select(
        "seq", ft.author_display(c("author")).alias("author_short"),
        ft.message_display(two_lines).alias("message_short"),
        *[v.alias(n) for n, v in ft.badge_columns(level, c("seq") % 3 == 0).items()],
    )


@query("p28_file_priority", wa(["v_numstat"], f"""SELECT {IDS}, CASE WHEN added = '-' THEN 4 WHEN regexp_matches(replace(path, chr(92), '/'), '{GEN_RE}') THEN 3 ELSE 1 END AS priority
 FROM (SELECT *, {CLEAN} AS path FROM v_numstat) q"""))
def p28(t):
    path = fp.clean_rename_path(c("raw_path"))
    return t.v_numstat.select(
        "seq", "num_ord", "l_partkey", "l_suppkey",
        fp.file_priority(c("added") == "-", fp.is_generated_file(path)).alias("priority"),
    )
