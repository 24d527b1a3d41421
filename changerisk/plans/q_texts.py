"""Queries of diffs, contexts, reviews and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from changerisk.operators import context as cx, diffs as df_, events as ev, features as ft, reviews as rv
from changerisk.plans.adapters import hash_of, with_adapters as wa
from changerisk.plans.catalog import query
from changerisk.plans.q_scalar import GEN_RE
from changerisk.session import materialize

c = F.col
NL = "chr(10)"

# --- oracle parts: diffs ---------------------------------------------------------------------
BLOCKS = f"""SELECT repo, full_hash, doc_id, i - 2 AS file_ord, concat('diff --git ', parts[i]) AS block
 FROM (SELECT repo, full_hash, doc_id, parts, unnest(range(2, len(parts) + 1)) AS i FROM (
   SELECT *, string_split_regex(concat({NL}, diff_text), '\\ndiff --git ') AS parts FROM v_diffs WHERE diff_text <> '') a) b"""
LINES_OF = "string_split(CASE WHEN right({x}, 1) = chr(10) THEN left({x}, length({x}) - 1) ELSE {x} END, chr(10))"
FILES0 = f"SELECT *, {LINES_OF.replace('{x}', 'block')} AS l FROM blocks"
FILES1 = """SELECT *, regexp_extract(l[1], '^diff --git a/(.*?) b/(.*)', 1) AS p_old, regexp_extract(l[1], '^diff --git a/(.*?) b/(.*)', 2) AS p_new, l[2:10] AS h FROM files0"""
STATUS = """coalesce(list_filter(list_transform(h, lambda x: CASE WHEN starts_with(x, 'new file mode') THEN 'ADDED' WHEN starts_with(x, 'deleted file mode') THEN 'DELETED'
  WHEN starts_with(x, 'rename ') THEN 'RENAMED' WHEN starts_with(x, 'copy ') THEN 'COPIED' END), lambda x: x IS NOT NULL)[-1], 'MODIFIED')"""
FILES2 = f"""SELECT *, {STATUS} AS status, len(list_filter(h, lambda x: contains(x, 'Binary files'))) > 0 AS is_binary,
 coalesce(regexp_extract(list_filter(h, lambda x: regexp_matches(x, '^(rename|copy) from'))[-1], '^(?:rename|copy) from (.*)$', 1), p_old) AS old_path,
 coalesce(regexp_extract(list_filter(h, lambda x: regexp_matches(x, '^(rename|copy) to'))[-1], '^(?:rename|copy) to (.*)$', 1), p_new) AS new_path FROM files1"""
FILES = f"SELECT *, regexp_matches(new_path, '{GEN_RE}') AS is_generated FROM files2"
# One row per line of every block, with the running number of hunk headers before it.
RAW = """SELECT repo, full_hash, file_ord, j, l[j] AS line, CAST(sum(CASE WHEN regexp_matches(l[j], '^@@ -\\d+(,\\d+)? \\+\\d+(,\\d+)? @@') THEN 1 ELSE 0 END)
 OVER (PARTITION BY repo, full_hash, file_ord ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS hunk_no
 FROM (SELECT *, unnest(range(1, len(l) + 1)) AS j FROM files WHERE NOT is_binary) q"""
HUNKS = """SELECT repo, full_hash, file_ord, hunk_no, j AS head_at, CAST(regexp_extract(line, '^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@(.*)', 1) AS BIGINT) AS old_start,
 coalesce(TRY_CAST(regexp_extract(line, '^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@(.*)', 2) AS BIGINT), 1) AS old_lines, CAST(regexp_extract(line, '^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@(.*)', 3) AS BIGINT) AS new_start,
 coalesce(TRY_CAST(regexp_extract(line, '^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@(.*)', 4) AS BIGINT), 1) AS new_lines, trim(regexp_extract(line, '^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@(.*)', 5)) AS header
 FROM raw WHERE regexp_matches(line, '^@@ -\\d+(,\\d+)? \\+\\d+(,\\d+)? @@')"""
DLINES = """SELECT repo, full_hash, file_ord, hunk_ord, CAST(row_number() OVER w AS INTEGER) - 1 AS line_ord, line_type,
 CASE WHEN line_type <> '+' THEN old_start + count(*) FILTER (line_type <> '+') OVER w - 1 END AS old_lineno,
 CASE WHEN line_type <> '-' THEN new_start + count(*) FILTER (line_type <> '-') OVER w - 1 END AS new_lineno, content
 FROM (SELECT r.*, h.old_start, h.new_start, CAST(r.hunk_no - 1 AS INTEGER) AS hunk_ord, CASE WHEN line = '' THEN ' ' ELSE left(line, 1) END AS line_type, substr(line, 2) AS content
  FROM raw r JOIN hunks h ON h.repo = r.repo AND h.full_hash = r.full_hash AND h.file_ord = r.file_ord AND h.hunk_no = r.hunk_no AND r.j > h.head_at
  WHERE line = '' OR left(line, 1) IN ('+', '-', ' ')) q
 WINDOW w AS (PARTITION BY repo, full_hash, file_ord, hunk_ord ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
COUNTS = """SELECT repo, full_hash, file_ord, count(*) FILTER (line_type = '+') AS plus, count(*) FILTER (line_type = '-') AS minus FROM dlines GROUP BY ALL"""
P_FILES = {"blocks": BLOCKS, "files0": FILES0, "files1": FILES1, "files2": FILES2, "files": FILES}
P_LINES = {**P_FILES, "raw": RAW, "hunks": HUNKS, "dlines": DLINES}
NUM = """SELECT repo, full_hash, 0 AS num_ord, concat('lib/new', CAST(doc_id AS STRING), '.txt') AS path, concat('{old name.txt => lib/new', CAST(doc_id AS STRING), '.txt}') AS raw_path, CAST(5 AS BIGINT) AS added, CAST(6 AS BIGINT) AS deleted, false AS is_binary FROM v_diffs
 UNION ALL SELECT repo, full_hash, 1, 'n.py', 'n.py', doc_id, CAST(0 AS BIGINT), false FROM v_diffs UNION ALL SELECT repo, full_hash, 2, 'n.py', 'n.py', CAST(99 AS BIGINT), CAST(99 AS BIGINT), false FROM v_diffs
 UNION ALL SELECT repo, full_hash, 3, 'z.c', 'z.c', CAST(0 AS BIGINT), CAST(0 AS BIGINT), true FROM v_diffs"""
STAT = """SELECT f.repo, f.full_hash, f.file_ord, coalesce(n.added, k.plus, 0) AS additions, coalesce(n.deleted, k.minus, 0) AS deletions, f.is_binary OR coalesce(n.is_binary, false) AS is_binary FROM files f
 LEFT JOIN counts k USING (repo, full_hash, file_ord) LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY f.repo, f.full_hash, f.file_ord ORDER BY num_ord) AS rn, f.file_ord AS fo FROM num m JOIN (SELECT repo, full_hash, file_ord, old_path, new_path FROM files) f
  ON f.repo = m.repo AND f.full_hash = m.full_hash AND (m.path IN (f.new_path, f.old_path) OR m.raw_path IN (f.new_path, f.old_path))) n ON n.repo = f.repo AND n.full_hash = f.full_hash AND n.fo = f.file_ord AND n.rn = 1"""
P_STAT = {**P_LINES, "counts": COUNTS, "num": NUM, "stat": STAT}


def files(t):
    return df_.classify_files(df_.split_diff_files(t.v_diffs))


def numstat(t):
    base = t.v_diffs.select("repo", "full_hash", "doc_id")
    doc = c("doc_id").cast("string")
    new = F.concat(F.lit("lib/new"), doc, F.lit(".txt"))

    def row(i, path, raw, added, deleted, binary):
        return F.struct(F.lit(i).alias("num_ord"), path.alias("path"), raw.alias("raw_path"), added.cast("bigint").alias("added"),
                        F.lit(deleted).cast("bigint").alias("deleted"), F.lit(binary).alias("is_binary"))

    n, z = F.lit("n.py"), F.lit("z.c")
    rows = F.array(
        row(0, new, F.concat(F.lit("{old name.txt => "), new, F.lit("}")), F.lit(5), 6, False),
        row(1, n, n, c("doc_id"), 0, False), row(2, n, n, F.lit(99), 99, False), row(3, z, z, F.lit(0), 0, True),
    )
    return base.select("repo", "full_hash", F.inline(rows))


def counted(t):
    return df_.match_numstat(files(t), numstat(t))


@query("n1_split_diff_files", wa(["v_diffs"], "SELECT repo, full_hash, file_ord, p_old AS old_path, p_new AS new_path, CAST(length(block) AS BIGINT) AS chars FROM files1", P_FILES))
def n1(t):
    out = df_.split_diff_files(t.v_diffs)
    # a block keeps the break before the next header, which the oracle's split takes away
    body = F.regexp_replace("block", r"\n\z", "")
    oracle_len = F.length(F.when(c("last"), c("block")).otherwise(body))
    from pyspark.sql import Window

    w = Window.partitionBy("repo", "full_hash").orderBy(F.desc("file_ord"))
    tagged = out.withColumn("last", F.row_number().over(w) == 1)
    return tagged.select("repo", "full_hash", "file_ord", "old_path", "new_path", oracle_len.cast("bigint").alias("chars"))


@query("n2_classify_files", wa(["v_diffs"], "SELECT f.repo, f.full_hash, f.file_ord, status, old_path, new_path, is_binary, is_generated, coalesce(plus, 0) AS additions, coalesce(minus, 0) AS deletions FROM files f LEFT JOIN counts k USING (repo, full_hash, file_ord)", {**P_LINES, "counts": COUNTS}))
def n2(t):
    out = df_.match_numstat(files(t))
    return out.select("repo", "full_hash", "file_ord", "status", "old_path", "new_path", "is_binary", "is_generated", "additions", "deletions")


@query("n3_diff_hunks", wa(["v_diffs"], "SELECT repo, full_hash, file_ord, CAST(hunk_no - 1 AS INTEGER) AS hunk_ord, old_start, old_lines, new_start, new_lines, header FROM hunks", P_LINES))
def n3h(t):
    return df_.diff_hunks(files(t)).drop("lines")


@query("n3_diff_lines", wa(["v_diffs"], "SELECT * FROM dlines", P_LINES))
def n3(t):
    return df_.explode_diff_lines(files(t))


@query("j6_match_numstat", wa(["v_diffs"], "SELECT * FROM stat", P_STAT))
def j6(t):
    return counted(t).select("repo", "full_hash", "file_ord", "additions", "deletions", "is_binary")


@query("a20_diff_totals", wa(["v_diffs"], """SELECT d.repo, d.full_hash, count(s.file_ord) AS files, CAST(coalesce(sum(additions), 0) AS BIGINT) AS total_additions, CAST(coalesce(sum(deletions), 0) AS BIGINT) AS total_deletions, count(s.file_ord) = 0 AS is_empty_commit
 FROM v_diffs d LEFT JOIN stat s ON s.repo = d.repo AND s.full_hash = d.full_hash GROUP BY d.repo, d.full_hash""", P_STAT))
def a20(t):
    return df_.diff_totals(t.v_diffs, counted(t))


@query("n4_commit_diff_json", wa(["v_diffs"], """SELECT d.repo, d.full_hash, count(s.file_ord) AS files, CAST(coalesce(sum(additions), 0) AS BIGINT) AS additions, CAST(CASE WHEN count(s.file_ord) > 0 THEN count(s.file_ord) END AS INT) AS listed
 FROM v_diffs d LEFT JOIN stat s ON s.repo = d.repo AND s.full_hash = d.full_hash GROUP BY d.repo, d.full_hash""", P_STAT))
def n4(t):
    """Fields read back from the nested diff document of each commit."""
    fields = F.json_tuple("json", "files", "total_additions", "files_changed").alias("files", "additions", "listed")
    return df_.assemble_commit_diff(t.v_diffs, counted(t)).select("repo", "full_hash", fields).select(
        "repo", "full_hash", c("files").cast("bigint").alias("files"), c("additions").cast("bigint").alias("additions"),
        F.json_array_length("listed").alias("listed"),
    )


# --- contexts --------------------------------------------------------------------------------
HTEXT = """SELECT h.repo, h.full_hash, h.file_ord, string_agg(concat(h.header, coalesce(b.body, '')), chr(10) ORDER BY h.hunk_no) AS body FROM hunks h
 LEFT JOIN (SELECT repo, full_hash, file_ord, hunk_ord, string_agg(concat(chr(10), line_type, content), '' ORDER BY line_ord) AS body FROM dlines GROUP BY ALL) b
 ON b.repo = h.repo AND b.full_hash = h.full_hash AND b.file_ord = h.file_ord AND b.hunk_ord = h.hunk_no - 1 GROUP BY h.repo, h.full_hash, h.file_ord"""
FTEXT = """SELECT f.repo, f.full_hash, f.file_ord, f.status, f.new_path, f.is_generated, f.is_binary, CASE WHEN is_binary THEN 4 WHEN is_generated THEN 3 ELSE 1 END AS priority,
 concat('--- ', old_path, chr(10), '+++ ', new_path, chr(10), CASE WHEN is_binary THEN concat('Binary files differ', chr(10)) WHEN is_generated THEN concat('[Generated file omitted from diff: ', new_path, ']', chr(10))
  WHEN t.body IS NULL THEN '' ELSE concat(t.body, chr(10)) END) AS text FROM files f LEFT JOIN htext t USING (repo, full_hash, file_ord)"""
PACK = """SELECT *, CASE WHEN upto <= 400 THEN 'included' WHEN upto - bytes <= 400 AND 400 - (upto - bytes) > 20 THEN 'cut' ELSE 'dropped' END AS state FROM (
 SELECT *, CAST(sum(bytes) OVER (PARTITION BY repo, full_hash ORDER BY priority, file_ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto FROM (
 SELECT repo, full_hash, file_ord, priority, CAST(strlen(text) AS BIGINT) AS bytes FROM ftext) a) b"""
KEPT = "SELECT repo, full_hash, file_ord, priority, bytes, state, CASE state WHEN 'included' THEN bytes WHEN 'cut' THEN 400 - (upto - bytes) ELSE 0 END AS kept_bytes FROM pack"
P_PACK = {**P_LINES, "htext": HTEXT, "ftext": FTEXT, "pack": PACK, "kept": KEPT}


@query("w10_context_packing", wa(["v_diffs"], "SELECT * FROM kept", P_PACK))
def w10(t):
    return cx.pack_context(cx.file_text(files(t)), 400)


@query("n7_context_sizes", wa(["v_diffs"], "SELECT repo, full_hash, CAST(sum(bytes) AS BIGINT) AS original_bytes, CAST(sum(kept_bytes) AS BIGINT) AS included_bytes, count(*) FILTER (state <> 'included') AS truncated_files, count(*) FILTER (state <> 'included') > 0 AS is_truncated FROM kept GROUP BY repo, full_hash", P_PACK))
def n7s(t):
    return cx.packing_summary(cx.pack_context(cx.file_text(files(t)), 400))


CONTEXT = """SELECT d.repo, d.full_hash, concat('Commit: ', d.full_hash, chr(10), 'Author: dev', chr(10), 'Date: 2024', chr(10), 'Message: m', chr(10), 'Stats: ', coalesce(i.n, 0), ' files changed, ', coalesce(i.plus, 0), ' additions (+), ', coalesce(i.minus, 0), ' deletions (-)', chr(10),
 'Risk score: not provided', chr(10), '## Changed files', chr(10), coalesce(i.inv, 'No files changed.'), chr(10), '## Diff', chr(10), coalesce(i.diff, '')) AS context FROM v_diffs d LEFT JOIN (
 SELECT x.repo, x.full_hash, count(*) AS n, CAST(sum(additions) AS BIGINT) AS plus, CAST(sum(deletions) AS BIGINT) AS minus,
  string_agg(concat('- ', new_path, ' (', status, '): +', additions, ' -', deletions, CASE WHEN is_generated THEN ' [GENERATED]' ELSE '' END, CASE WHEN x.is_binary THEN ' [BINARY]' ELSE '' END), chr(10) ORDER BY file_ord) AS inv,
  string_agg(text, chr(10) ORDER BY priority, file_ord) AS diff FROM ftext x JOIN (SELECT repo, full_hash, file_ord, coalesce(plus, 0) AS additions, coalesce(minus, 0) AS deletions FROM files LEFT JOIN counts USING (repo, full_hash, file_ord)) s USING (repo, full_hash, file_ord) GROUP BY x.repo, x.full_hash) i
 ON i.repo = d.repo AND i.full_hash = d.full_hash"""


@query("n7_review_context", wa(["v_diffs"], CONTEXT, {**P_LINES, "counts": COUNTS, "htext": HTEXT, "ftext": FTEXT}))
def n7(t):
    commits = t.v_diffs.select("repo", "full_hash", F.lit("dev").alias("author"), F.lit("2024").alias("commit_timestamp"), F.lit("m").alias("subject"))
    whole = df_.match_numstat(files(t))
    out = cx.build_review_context(commits, cx.file_text(whole), budget=2**31 - 1)
    return out.select("repo", "full_hash", "context")


# --- reviews ---------------------------------------------------------------------------------
CLEAN = """SELECT repo, full_hash, doc_id, raw_text, CASE WHEN starts_with(raw_text, '```') THEN regexp_extract(raw_text, '(?is)^```(?:json)?\\s*\\n?(.*?)\\n?```$', 1) ELSE trim(raw_text) END AS j0 FROM v_reviews"""
PARSED = "SELECT repo, full_hash, doc_id, raw_text, CASE WHEN json_valid(j0) THEN CAST(j0 AS JSON) END AS j FROM clean"


def _jt(path: str, x: str = "j") -> str:
    return f"coalesce(json_type({x}, '{path}'), 'NONE')"


def _list_rule(name: str) -> str:
    return f"""WHEN {_jt('$.' + name)} <> 'ARRAY' THEN '{name}_not_list' WHEN len(list_filter(json_extract(j, '$.{name}[*]'), lambda x: json_type(x) <> 'VARCHAR')) > 0 THEN '{name}_element_type'"""


_RF0 = "$.potential_risk_factors[0]"
_MISSING = " OR ".join(f"json_type(j, '$.{k}') IS NULL" for k in rv.REQUIRED_KEYS)
REASON = f"""CASE WHEN raw_text IS NULL OR trim(raw_text) = '' THEN 'empty' WHEN j IS NULL THEN 'invalid_json' WHEN json_type(j) <> 'OBJECT' THEN 'not_object' WHEN {_MISSING} THEN 'missing_field'
 WHEN {_jt('$.summary')} <> 'VARCHAR' THEN 'summary_type' {" ".join(_list_rule(n) for n in rv.STRING_LISTS)}
 WHEN {_jt('$.potential_risk_factors')} <> 'ARRAY' THEN 'risk_factors_not_list'
 WHEN json_array_length(j, '$.potential_risk_factors') > 0 AND {_jt(_RF0)} <> 'OBJECT' THEN 'factor_not_object'
 WHEN json_array_length(j, '$.potential_risk_factors') > 0 AND ({" OR ".join(f"json_type(j, '{_RF0}.{k}') IS NULL" for k in rv.FACTOR_KEYS)}) THEN 'factor_missing_field'
 WHEN {_jt(_RF0 + '.category', 'j')} <> 'VARCHAR' OR {_jt(_RF0 + '.description')} <> 'VARCHAR' OR {_jt(_RF0 + '.file_path')} <> 'VARCHAR' THEN 'factor_field_type'
 WHEN json_extract_string(j, '{_RF0}.review_priority') NOT IN ('LOW', 'MEDIUM', 'HIGH') THEN 'factor_priority'
 WHEN {_jt(_RF0 + '.line_range')} NOT IN ('VARCHAR', 'NULL') THEN 'factor_line_range_type'
 WHEN {_jt('$.recommended_review_actions')} <> 'ARRAY' THEN 'actions_not_list'
 WHEN {_jt('$.recommended_review_actions[0].action')} <> 'VARCHAR' THEN 'action_missing_action'
 WHEN {_jt('$.recommended_review_actions[0].target_file')} NOT IN ('VARCHAR', 'NULL', 'NONE') THEN 'action_target_type' END"""
JUDGED = f"SELECT *, {REASON} AS reject_reason FROM parsed"
P_REV = {"clean": CLEAN, "parsed": PARSED, "judged": JUDGED}


@query("n5_parse_reviews", wa(["v_reviews"], """SELECT repo, full_hash, reject_reason, CASE WHEN reject_reason IS NULL THEN full_hash END AS commit_hash, CASE WHEN reject_reason IS NULL THEN json_extract_string(j, '$.summary') END AS summary,
 CASE WHEN reject_reason IS NULL THEN CAST(json_array_length(j, '$.potential_risk_factors') AS INTEGER) END AS factors, CASE WHEN reject_reason IS NULL THEN 'unknown' END AS model_name FROM judged""", P_REV))
def n5(t):
    out = rv.parse_reviews(t.v_reviews)
    return out.select(
        "repo", "full_hash", "reject_reason", c("review.commit_hash").alias("commit_hash"), c("review.summary").alias("summary"),
        F.when(c("review").isNotNull(), F.size("review.potential_risk_factors")).alias("factors"), c("review.model_name").alias("model_name"),
    )


FACTORS = f"""SELECT repo, full_hash, CAST(i AS INTEGER) AS factor_no, json_extract_string(rf, '$.file_path') AS file_path, json_extract_string(rf, '$.line_range') AS line_range, coalesce(json_extract_string(rf, '$.evidence_snippet'), '') AS snippet
 FROM (SELECT repo, full_hash, i, json_extract(j, concat('$.potential_risk_factors[', i, ']')) AS rf FROM (SELECT *, unnest(range(0, json_array_length(j, '$.potential_risk_factors')::BIGINT)) AS i FROM judged WHERE reject_reason IS NULL) a) b"""
MATCHED = """SELECT fa.repo, fa.full_hash, fa.factor_no, min(f.file_ord) AS file_ord FROM factors fa JOIN files f ON f.repo = fa.repo AND f.full_hash = fa.full_hash
 AND fa.file_path <> '' AND (fa.file_path = f.new_path OR fa.file_path = f.old_path OR (f.new_path <> '' AND (ends_with(f.new_path, fa.file_path) OR ends_with(fa.file_path, f.new_path)))) GROUP BY ALL"""
RRE = "(?i)^\\s*L?(\\d+)(?:\\s*-\\s*L?(\\d+))?\\s*$"
RANGED = f"""SELECT fa.*, m.file_ord, coalesce(trim(line_range), '') <> '' AS has_range, regexp_matches(coalesce(line_range, ''), '{RRE}') AS ok, least(a, coalesce(b, a)) AS lo, greatest(a, coalesce(b, a)) AS hi FROM (
 SELECT *, TRY_CAST(regexp_extract(line_range, '{RRE}', 1) AS BIGINT) AS a, TRY_CAST(regexp_extract(line_range, '{RRE}', 2) AS BIGINT) AS b FROM factors) fa LEFT JOIN matched m USING (repo, full_hash, factor_no)"""
VERIFIED = """SELECT r.repo, r.full_hash, r.factor_no, r.file_ord, r.file_ord IS NOT NULL
 AND (NOT has_range OR (ok AND (EXISTS (SELECT 1 FROM dlines d WHERE d.repo = r.repo AND d.full_hash = r.full_hash AND d.file_ord = r.file_ord AND (d.old_lineno BETWEEN r.lo AND r.hi OR d.new_lineno BETWEEN r.lo AND r.hi))
   OR EXISTS (SELECT 1 FROM hunks h WHERE h.repo = r.repo AND h.full_hash = r.full_hash AND h.file_ord = r.file_ord AND ((h.old_lines > 0 AND h.old_start <= r.hi AND h.old_start + h.old_lines - 1 >= r.lo) OR (h.new_lines > 0 AND h.new_start <= r.hi AND h.new_start + h.new_lines - 1 >= r.lo))))))
 AND (snippet = '' OR coalesce(contains(x.body, snippet), false) OR EXISTS (SELECT 1 FROM dlines d WHERE d.repo = r.repo AND d.full_hash = r.full_hash AND d.file_ord = r.file_ord AND trim(d.content) <> '' AND contains(snippet, trim(d.content)))) AS evidence_verified
 FROM ranged r LEFT JOIN (SELECT repo, full_hash, file_ord, string_agg(content, chr(10) ORDER BY hunk_ord, line_ord) AS body FROM dlines GROUP BY ALL) x ON x.repo = r.repo AND x.full_hash = r.full_hash AND x.file_ord = r.file_ord"""
P_EVID = {**P_LINES, **P_REV, "factors": FACTORS, "matched": MATCHED, "ranged": RANGED}


def factors(t):
    return rv.risk_factors(rv.parse_reviews(t.v_reviews))


@query("j7_cited_file", wa(["v_diffs", "v_reviews"], "SELECT fa.repo, fa.full_hash, fa.factor_no, fa.file_path, m.file_ord FROM factors fa LEFT JOIN matched m USING (repo, full_hash, factor_no)", P_EVID))
def j7(t):
    named = materialize(files(t).select("repo", "full_hash", "file_ord", "old_path", "new_path"))
    out = rv.match_cited_file(factors(t), named)
    return out.select("repo", "full_hash", "factor_no", "file_path", "file_ord")


@query("j8_line_grounding", wa(["v_diffs"], """SELECT l.repo, l.full_hash, l.file_ord, l.q, l.lo, l.hi, EXISTS (SELECT 1 FROM dlines d WHERE d.repo = l.repo AND d.full_hash = l.full_hash AND d.file_ord = l.file_ord AND (d.old_lineno BETWEEN l.lo AND l.hi OR d.new_lineno BETWEEN l.lo AND l.hi))
   OR EXISTS (SELECT 1 FROM hunks h WHERE h.repo = l.repo AND h.full_hash = l.full_hash AND h.file_ord = l.file_ord AND ((h.old_lines > 0 AND h.old_start <= l.hi AND h.old_start + h.old_lines - 1 >= l.lo) OR (h.new_lines > 0 AND h.new_start <= l.hi AND h.new_start + h.new_lines - 1 >= l.lo))) AS overlaps
 FROM (SELECT repo, full_hash, file_ord, q, 1 + (q * 37 + doc_id) % 520 AS lo, 1 + (q * 37 + doc_id) % 520 + doc_id % 4 AS hi FROM files, range(0, 6) r(q)) l""", P_LINES))
def j8(t):
    parts = files(t)
    docs = t.v_diffs.select("repo", "full_hash", "doc_id")
    q = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint")))
    asked = df_.split_diff_files(t.v_diffs).join(docs, ["repo", "full_hash"]).select("repo", "full_hash", "file_ord", "doc_id", q.alias("q"))
    lo = 1 + (c("q") * 37 + c("doc_id")) % 520
    asked = asked.select("repo", "full_hash", "file_ord", "q", lo.alias("lo"), (lo + c("doc_id") % 4).alias("hi"))
    from changerisk.operators.ranges import overlap_exists

    return overlap_exists(asked, rv.hunk_extents(parts), ["repo", "full_hash", "file_ord"], ("lo", "hi"), ("first_line", "last_line"))


@query("j9_snippet_grounding", wa(["v_diffs"], """SELECT x.repo, x.full_hash, x.file_ord, contains(body, concat('e ', lang)) OR list_bool_or(list_transform(parts, lambda p: trim(p) <> '' AND contains(concat('e ', lang), trim(p)))) AS found
 FROM (SELECT repo, full_hash, file_ord, string_agg(content, chr(10) ORDER BY hunk_ord, line_ord) AS body, list(content) AS parts FROM dlines GROUP BY ALL) x JOIN (SELECT v.repo, v.full_hash, d.lang FROM v_diffs v JOIN documents d USING (doc_id)) k ON k.repo = x.repo AND k.full_hash = x.full_hash""", P_LINES))
def j9(t):
    langs = t.v_diffs.join(t.documents.select("doc_id", "lang"), "doc_id").select("repo", "full_hash", "lang")
    texts = rv.file_contents(files(t)).where(F.size("contents") > 0).join(langs, ["repo", "full_hash"])
    return texts.select("repo", "full_hash", "file_ord", rv.snippet_found(F.concat(F.lit("e "), "lang"), c("contents")).alias("found"))


@query("n6_verify_evidence", wa(["v_diffs", "v_reviews"], VERIFIED, P_EVID))
def n6(t):
    return rv.verify_evidence(factors(t), files(t)).select("repo", "full_hash", "factor_no", "file_ord", "evidence_verified")


# --- events ----------------------------------------------------------------------------------
SECRET = "change-risk-demo-secret"
_KEY = SECRET.encode().ljust(64, b"\0")
IPAD, OPAD = bytes(0x36 ^ b for b in _KEY).hex(), bytes(0x5C ^ b for b in _KEY).hex()
SIGNED = f"SELECT *, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN concat('sha256=', mac2) WHEN 2 THEN concat('SHA256=', mac) WHEN 3 THEN concat('sha256=', upper(mac)) ELSE concat('sha256=', mac) END AS signature FROM (SELECT *, sha256(concat(body_text, 'x')) AS mac2, sha256(unhex('{OPAD}') || unhex(sha256(unhex('{IPAD}') || encode(body_text)))) AS mac FROM v_bodies) q"
PJSON = "SELECT *, CASE WHEN json_valid(body_text) THEN CAST(body_text AS JSON) END AS j FROM signed"
SHA = "^[0-9a-fA-F]{40}$"
EFIELDS = """SELECT *, coalesce(json_extract_string(j, '$.action'), '') AS action, coalesce(nullif(json_extract_string(j, '$.pull_request.base.repo.owner.login'), ''), json_extract_string(j, '$.pull_request.head.repo.owner.login'), '') AS owner,
 coalesce(nullif(json_extract_string(j, '$.pull_request.base.repo.name'), ''), json_extract_string(j, '$.pull_request.head.repo.name'), '') AS repository, coalesce(json_extract_string(j, '$.pull_request.state'), 'open') AS state,
 coalesce(json_extract_string(j, '$.pull_request.base.sha'), '') AS base_sha, coalesce(json_extract_string(j, '$.pull_request.head.sha'), '') AS head_sha FROM pjson"""
EREASON = f"""CASE WHEN signature IS NULL THEN 'missing_signature' WHEN NOT (starts_with(signature, 'sha256=') AND lower(substr(signature, 8)) = mac) THEN 'bad_signature' WHEN event_type <> 'pull_request' THEN 'unsupported_event'
 WHEN j IS NULL THEN 'malformed_json' WHEN json_type(j) <> 'OBJECT' THEN 'not_object' WHEN action NOT IN ('opened', 'synchronize', 'reopened') THEN 'unsupported_action'
 WHEN json_type(j, '$.pull_request') <> 'OBJECT' THEN 'missing_pull_request' WHEN state <> 'open' THEN 'not_open' WHEN NOT regexp_matches(owner, '^[a-zA-Z0-9_.-]+$') THEN 'invalid_owner' WHEN NOT regexp_matches(repository, '^[a-zA-Z0-9_.-]+$') THEN 'invalid_repository'
 WHEN json_type(j, '$.pull_request.number') NOT IN ('UBIGINT', 'BIGINT') OR CAST(json_extract_string(j, '$.pull_request.number') AS BIGINT) <= 0 THEN 'invalid_number'
 WHEN NOT regexp_matches(base_sha, '{SHA}') THEN 'invalid_base_sha' WHEN NOT regexp_matches(head_sha, '{SHA}') THEN 'invalid_head_sha' END"""
P_EV = {"signed": SIGNED, "pjson": PJSON, "efields": EFIELDS, "ejudged": f"SELECT *, {EREASON} AS reject_reason FROM efields"}


def event_rows(t):
    """Raw (headers, body) rows with good, bad, missing and upper-case signatures."""
    body = F.encode("body_text", "UTF-8")
    mac = ev.hmac_sha256(body, SECRET)
    k = c("event_id") % 6
    sig = (
        F.when(k == 0, None).when(k == 1, F.concat(F.lit("sha256="), F.sha2(F.concat("body_text", F.lit("x")), 256)))
        .when(k == 2, F.concat(F.lit("SHA256="), mac)).when(k == 3, F.concat(F.lit("sha256="), F.upper(mac)))
        .otherwise(F.concat(F.lit("sha256="), mac))
    )
    headers = F.map_from_arrays(
        F.array(F.lit("X-Hub-Signature-256"), F.lit("X-GitHub-Delivery"), F.lit("x-github-event")), F.array(sig, c("delivery_id"), c("event_type"))
    )
    return t.v_bodies.select("event_id", headers.alias("headers"), body.alias("body"), c("ts").cast("timestamp").alias("received_at"))


@query("st1_authenticate_events", wa(["v_bodies"], """SELECT event_id, CASE WHEN signature IS NULL THEN 'missing_signature' WHEN NOT (starts_with(signature, 'sha256=') AND lower(substr(signature, 8)) = mac) THEN 'bad_signature' ELSE 'ok' END AS auth, mac FROM signed""", {"signed": SIGNED}))
def st1(t):
    rows = event_rows(t)
    sig = ev.header(c("headers"), "x-hub-signature-256")
    auth = F.when(sig.isNull(), "missing_signature").when(~ev.signature_ok(c("body"), sig, SECRET), "bad_signature").otherwise("ok")
    return rows.select("event_id", auth.alias("auth"), ev.hmac_sha256(c("body"), SECRET).alias("mac"))


@query("n9_pr_payloads", wa(["v_bodies"], """SELECT event_id, delivery_id, reject_reason, CASE WHEN reject_reason IS NULL THEN owner END AS owner, CASE WHEN reject_reason IS NULL THEN repository END AS repository,
 CASE WHEN reject_reason IS NULL THEN CAST(json_extract_string(j, '$.pull_request.number') AS BIGINT) END AS number, CASE WHEN reject_reason IS NULL THEN head_sha END AS head_sha FROM ejudged""", P_EV))
def n9(t):
    out = ev.classify_events(event_rows(t), SECRET)
    ok = c("reject_reason").isNull()
    return out.select("event_id", "delivery_id", "reject_reason", *[F.when(ok, c(x)).alias(x) for x in ("owner", "repository", "number", "head_sha")])


@query("f6_supported_events", wa(["v_bodies"], "SELECT event_id, action FROM (SELECT *, v_.event_type AS et FROM efields v_) q WHERE et = 'pull_request' AND action IN ('opened', 'synchronize', 'reopened') AND state = 'open'", P_EV))
def f6(t):
    v = F.try_parse_json("body_text")
    path = lambda p: F.try_variant_get(v, p, "string")
    rows = t.v_bodies.select("event_id", "event_type", path("$.action").alias("action"), path("$.pull_request.state").alias("state"))
    return ev.supported_events(rows).select("event_id", "action")
