"""Diffs, contexts, reviews and evidence."""

import json
import random

from pyspark.sql import functions as F

from changerisk.operators import context as cx, diffs as df_, reviews as rv

DIFF = """diff --git a/src/app.py b/src/app.py
index 1..2 100644
--- a/src/app.py
+++ b/src/app.py
@@ -10,4 +10,5 @@ def run():
 ctx
-old value
+new value
+++counter
 
 tail
\\ No newline at end of file
@@ -40 +41 @@
-a
+b
diff --git a/old name.txt b/new.txt
similarity index 90%
rename from old name.txt
rename to new.txt
diff --git a/i.png b/i.png
new file mode 100644
Binary files /dev/null and b/i.png differ
diff --git a/n.py b/n.py
new file mode 100644
--- /dev/null
+++ b/n.py
@@ -0,0 +1,2 @@
+import os
+
diff --git a/gone.c b/gone.c
deleted file mode 100644
--- a/gone.c
+++ /dev/null
@@ -1 +0,0 @@
-int x;
"""


def diffs(spark, *texts):
    return spark.createDataFrame([("r", f"h{i}", t) for i, t in enumerate(texts)], "repo string, full_hash string, diff_text string")


def files(spark, *texts, compat=False):
    return df_.classify_files(df_.split_diff_files(diffs(spark, *texts)), compat)


def test_files_and_counts(spark):
    rows = df_.match_numstat(files(spark, DIFF, "", "no diff here")).orderBy("file_ord").collect()
    got = [(r.old_path, r.new_path, r.status, r.is_binary, r.additions, r.deletions) for r in rows]
    assert got == [
        ("src/app.py", "src/app.py", "MODIFIED", False, 3, 2),
        ("old name.txt", "new.txt", "RENAMED", False, 0, 0),
        ("i.png", "i.png", "ADDED", True, 0, 0),
        ("n.py", "n.py", "ADDED", False, 2, 0),
        ("gone.c", "gone.c", "DELETED", False, 0, 1),
    ]


def test_line_numbers(spark):
    rows = df_.explode_diff_lines(files(spark, DIFF)).where("file_ord = 0").orderBy("hunk_ord", "line_ord").collect()
    assert [(r.hunk_ord, r.line_type, r.old_lineno, r.new_lineno, r.content) for r in rows] == [
        (0, " ", 10, 10, "ctx"), (0, "-", 11, None, "old value"), (0, "+", None, 11, "new value"), (0, "+", None, 12, "++counter"),
        (0, " ", 12, 13, ""), (0, " ", 13, 14, "tail"), (1, "-", 40, None, "a"), (1, "+", None, 41, "b"),
    ]
    compat = df_.explode_diff_lines(files(spark, DIFF, compat=True)).where("file_ord = 0 and hunk_ord = 0")
    assert compat.where("content like '%counter'").count() == 0


def test_line_numbers_of_a_long_hunk(spark):
    rng = random.Random(3)
    kinds = [rng.choice("+- ") for _ in range(3 * df_.PIECE + 5)]
    sizes = (len(kinds), df_.PIECE, 1)
    text = "diff --git a/long.txt b/long.txt\n--- a/long.txt\n+++ b/long.txt\n" + "".join(
        f"@@ -{7 * h + 1},9 +{5 * h + 1},9 @@\n" + "".join(f"{k}{i}\n" for i, k in enumerate(kinds[:n])) for h, n in enumerate(sizes)
    ).rstrip("\n")
    got = df_.explode_diff_lines(files(spark, text))
    expected = []
    for h, n in enumerate(sizes):
        old, new = 7 * h + 1, 5 * h + 1
        for i, k in enumerate(kinds[:n]):
            expected.append((h, i, k, None if k == "+" else old, None if k == "-" else new, str(i)))
            old, new = old + (k != "+"), new + (k != "-")
    columns = ("hunk_ord", "line_ord", "line_type", "old_lineno", "new_lineno", "content")
    assert sorted(tuple(r[x] for x in columns) for r in got.collect()) == expected
    assert "Exchange" not in got._jdf.queryExecution().toString().split("Physical Plan")[1]


def test_numstat_first_match_wins(spark):
    num = spark.createDataFrame(
        [("r", "h0", 0, "{old name => x}.txt", "new.txt", 7, 8, False), ("r", "h0", 1, "new.txt", "new.txt", 1, 1, False),
         ("r", "h0", 2, "n.py", "n.py", 0, 0, True)],
        "repo string, full_hash string, num_ord int, raw_path string, path string, added long, deleted long, is_binary boolean")
    got = {r.file_ord: r for r in df_.match_numstat(files(spark, DIFF), num).collect()}
    assert (got[1].additions, got[1].deletions) == (7, 8)
    assert got[3].is_binary and got[3].hunks == [] and got[3].additions == 0
    assert (got[0].additions, got[0].deletions) == (3, 2)
    total = df_.diff_totals(diffs(spark, DIFF, ""), df_.match_numstat(files(spark, DIFF, ""), num)).orderBy("full_hash").collect()
    assert [(r.files, r.total_additions, r.is_empty_commit) for r in total] == [(5, 10, False), (0, 0, True)]


def test_nested_document(spark):
    r = df_.assemble_commit_diff(diffs(spark, DIFF), df_.match_numstat(files(spark, DIFF))).first()
    doc = json.loads(r.json)
    assert [f["new_path"] for f in doc["files_changed"]] == ["src/app.py", "new.txt", "i.png", "n.py", "gone.c"]
    assert doc["files_changed"][0]["hunks"][0]["header"] == "def run():"
    assert len(doc["files_changed"][0]["hunks"][0]["lines"]) == 6


def test_packing_follows_the_budget(spark):
    rows = [("r", "h", i, p, b) for i, (p, b) in enumerate([(3, 40), (1, 100), (1, 60), (4, 5)])]
    packed = spark.createDataFrame(rows, "repo string, full_hash string, file_ord int, priority int, bytes long")

    def state(budget):
        return {r.file_ord: (r.state, r.kept_bytes) for r in cx.pack_context(packed, budget).collect()}

    assert state(1000) == {0: ("included", 40), 1: ("included", 100), 2: ("included", 60), 3: ("included", 5)}
    assert state(150) == {1: ("included", 100), 2: ("cut", 50), 0: ("dropped", 0), 3: ("dropped", 0)}
    assert state(115) == {1: ("included", 100), 2: ("dropped", 0), 0: ("dropped", 0), 3: ("dropped", 0)}
    assert state(160) == {1: ("included", 100), 2: ("included", 60), 0: ("dropped", 0), 3: ("dropped", 0)}


def test_cut_keeps_whole_characters(spark):
    text = "aé€😀z"
    raw = text.encode()
    df = spark.createDataFrame([(n,) for n in range(len(raw) + 2)], "n long")
    got = df.select("n", cx.cut_utf8(F.lit(text), F.col("n")).alias("t")).collect()
    assert {r.n: r.t for r in got} == {n: raw[:n].decode("utf-8", errors="ignore") for n in range(len(raw) + 2)}


def test_context_text(spark):
    commits = spark.createDataFrame([("r", "h0", "A", "2024", "msg")], "repo string, full_hash string, author string, commit_timestamp string, subject string")
    whole = cx.file_text(df_.match_numstat(files(spark, DIFF)))
    text = cx.build_review_context(commits, whole, cx.MAX_BYTES).first()
    assert "- i.png (ADDED): +0 -0 [BINARY]" in text.context and not text.is_truncated
    assert text.context.index("+++ src/app.py") < text.context.index("Binary files differ")
    assert "@@" not in text.context and "def run():\n ctx\n-old value" in text.context
    small = cx.build_review_context(commits, whole, budget=60).first()
    assert small.is_truncated and small.included_bytes == 60 and "[TRUNCATED: Total diff exceeded" in small.context
    assert small.context.count("- ") >= 5


def review(**change):
    doc = {
        "summary": "s", "key_changes": ["k"], "affected_areas": [], "testing_observations": [],
        "potential_risk_factors": [
            {"category": "c", "description": "d", "review_priority": "HIGH", "file_path": "app.py", "line_range": None, "evidence_snippet": ""}],
        "recommended_review_actions": [{"action": "a", "target_file": None}],
    }
    doc.update(change)
    return doc


def test_review_contract(spark):
    ok = review()
    factor = ok["potential_risk_factors"][0]
    without = {k: v for k, v in ok.items() if k != "summary"}

    def rf(**kw):
        return json.dumps(review(potential_risk_factors=[factor, {**factor, **kw}]))

    cases = [
        (json.dumps(ok), None), ("```json\n" + json.dumps(ok) + "\n```", None), ("  ", "empty"), ("{bad", "invalid_json"), ("[1]", "not_object"),
        (json.dumps(without), "missing_field"), (json.dumps(review(summary=3)), "summary_type"),
        (json.dumps(review(key_changes="x")), "key_changes_not_list"), (json.dumps(review(affected_areas=["a", None])), "affected_areas_element_type"),
        (json.dumps(review(testing_observations=None)), "testing_observations_not_list"),
        (json.dumps(review(potential_risk_factors={})), "risk_factors_not_list"), (json.dumps(review(potential_risk_factors=["x"])), "factor_not_object"),
        (json.dumps(review(potential_risk_factors=[{"category": "c"}])), "factor_missing_field"), (rf(category=1), "factor_field_type"),
        (rf(review_priority="high"), "factor_priority"), (rf(line_range=4), "factor_line_range_type"), (rf(evidence_snippet=None), "factor_snippet_type"),
        (json.dumps(review(recommended_review_actions="x")), "actions_not_list"), (json.dumps(review(recommended_review_actions=[1])), "action_not_object"),
        (json.dumps(review(recommended_review_actions=[{"target_file": "f"}])), "action_missing_action"),
        (json.dumps(review(recommended_review_actions=[{"action": "a", "target_file": 1}])), "action_target_type"),
        (rf(surprise=1), "factor_fields"), (json.dumps(review(recommended_review_actions=[{"action": "a", "more": 1}])), "action_fields"),
    ]
    rows = [("r", f"h{i:02d}", t) for i, (t, _) in enumerate(cases)] + [("r", None, json.dumps(ok))]
    out = rv.parse_reviews(spark.createDataFrame(rows, "repo string, full_hash string, raw_text string")).collect()
    got = {r.full_hash: r for r in out}
    assert [got[f"h{i:02d}"].reject_reason for i in range(len(cases))] == [w for _, w in cases]
    assert got["h00"].review.commit_hash == "h00" and got["h00"].review.model_name == "unknown" and got["h05"].review is None
    assert got[None].review.commit_hash == "unknown"


def test_evidence(spark):
    cases = [
        ("src/app.py", None, "new value", True), ("app.py", "L11", "", True), ("p.py", "10-12", "old value", True), ("x/src/app.py", "", "", True),
        ("app.py", "L20-L30", "", False), ("app.py", "L45-L5", "", True), ("app.py", "somewhere", "", False), ("none.py", None, "", False),
        ("app.py", None, "not there", False), ("old name.txt", None, "", True), ("i.png", "L1", "", False), ("", None, "", False),
        ("gone.c", "1", "int x;", True), ("src\\app.py", None, "see: tail!", True), ("app.py", None, "ctx\nold value", True),
    ]
    rows = [("r", "h0", i, f, r, s) for i, (f, r, s, _) in enumerate(cases)]
    factors = spark.createDataFrame(rows, "repo string, full_hash string, factor_no int, file_path string, line_range string, evidence_snippet string")
    got = {r.factor_no: r.evidence_verified for r in rv.verify_evidence(factors, files(spark, DIFF)).collect()}
    assert got == {i: w for i, (*_, w) in enumerate(cases)}
    # a blank line in the file verifies any snippet in the compatible mode only
    loose = {r.factor_no: r.evidence_verified for r in rv.verify_evidence(factors, files(spark, DIFF), compat=True).collect()}
    assert loose[8] and not got[8]
