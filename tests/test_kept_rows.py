"""Rows that must not get lost, and the reasons that are given instead."""

from datetime import datetime

from pyspark.sql import functions as F

from changerisk.functions.rounding import round_exact
from changerisk.operators import dataset as ds, diffs as df_, evaluation as ev, graph as gr, labels as lb, provenance as pv, pulls as pu
from changerisk.sources import readers as rd
from changerisk.streaming import events as se


def commit(n):
    return f"{n:040x}"


def test_pull_request_commits_without_a_commit_row_stay(spark):
    members = spark.createDataFrame([(1, "r", commit(1), 1), (1, "r", commit(2), 2)], "pr_id long, repo string, full_hash string, seq long")
    commits = spark.createDataFrame([("r", commit(1), "A <a>", "2024", "s", [])], "repo string, full_hash string, author string, commit_timestamp string, subject string, parents array<string>")
    preds = spark.createDataFrame([("r", commit(1), 0.5, True, "MEDIUM", None)], "repo string, full_hash string, raw_probability double, is_above_threshold boolean, risk_level string, skip_reason string")
    rows = pu.pr_predictions(members, commits, preds)
    assert {(r.seq, r.author, r.error) for r in rows.collect()} == {(1, "A <a>", None), (2, "Unknown", "no_prediction")}
    assert pu.pr_summary(rows).first().total_commits == 2
    prs = spark.createDataFrame([(1, "r", commit(7), commit(8)), (2, "r", commit(7), commit(8))], "pr_id long, repo string, base string, head string")
    free = {r.pr_id: r for r in pu.render_reports(prs, rows).collect()}
    assert "Unknown" in free[1].report and "No commits introduced" in free[2].report and free[1].reject_reason is None
    capped = {r.pr_id: r for r in pu.render_reports(prs, rows, max_commits=1).collect()}
    assert capped[1].report is None and capped[1].reject_reason == "2 commits exceed the limit of 1"
    assert capped[2].report == free[2].report


def test_fixes_with_equal_short_hashes_are_two(spark):
    fixes = ["a" * 39 + "1", "a" * 39 + "2"]
    rows = [("r", "i", f, "", "HIGH", False, "p", 3) for f in fixes]
    evidence = spark.createDataFrame(rows, "repo string, intro_hash string, fix_hash string, issue_id string, confidence string, is_revert boolean, path string, traced_lines long")
    assert lb.evidence_summary(evidence).first().fixing_commits == ["aaaaaaa", "aaaaaaa"]


def test_rows_without_an_instant_are_undated(spark):
    rows = [("r", None if i == 3 else datetime(2024, 1, 1 + i), i, str(i)) for i in range(11)]
    split = {r.seq: r.split for r in ds.temporal_split(spark.createDataFrame(rows, "repo string, ts timestamp, seq long, full_hash string")).collect()}
    assert split[3] == "undated" and len(split) == 11
    assert [split[i] for i in (0, 7, 8, 9, 10)] == ["train", "train", "validation", "validation", "test"]


def test_marks_after_the_ninth_header_line_count(spark):
    text = "diff --git a/gen/package-lock.json b/kept.txt\n" + "x: y\n" * 12 + "rename from gen/package-lock.json\nrename to kept.txt\n@@ -1 +1 @@\n-a\n+b\n"
    files = df_.split_diff_files(spark.createDataFrame([("r", "h", text)], "repo string, full_hash string, diff_text string"))
    assert df_.classify_files(files).first().status == "RENAMED"
    assert df_.classify_files(files).first().is_generated
    assert df_.classify_files(files, compat=True).first().status == "MODIFIED"


def test_large_values_are_rounded(one):
    assert one([123456789012.34567, 2.0**60, -9e11 - 0.26], lambda x: round_exact(F.col(x), 2), "x double") == [123456789012.35, 2.0**60, -900000000000.26]


def test_a_path_deleted_and_added_in_one_commit(spark):
    rows = [("r", 1, "a", "A", None, "p"), ("r", 2, "b", "D", None, "p"), ("r", 2, "b", "A", None, "p"), ("r", 3, "c", "M", None, "p")]
    got = pv.file_lineage(spark.createDataFrame(rows, "repo string, seq long, full_hash string, status string, old_path string, path string")).collect()
    lives = {(r.full_hash, r.status): r.lineage for r in got}
    assert len(got) == 4 and lives["a", "A"] == lives["b", "D"] != lives["b", "A"] == lives["c", "M"]


def test_first_revisions_trace_to_nothing(spark):
    history = spark.createDataFrame([("r", "f", "a", 1, 1, 1, 1, 2)], "repo string, lineage string, full_hash string, rev_no long, old_start long, old_count long, new_start long, new_count long")
    got = pv.fix_origins(history, history.select("repo", "full_hash"))
    assert got.count() == 0 and "origin_sha" in got.columns


def test_names_go_before_hashes(spark):
    commits = spark.createDataFrame([("r", commit(0xABCDEF << 136)), ("r", commit(5))], "repo string, full_hash string")
    names = spark.createDataFrame([("r", "main", commit(5)), ("r", "two", commit(5)), ("r", "two", commit(6)), ("r", "00abcdef", commit(5))], "repo string, name string, full_hash string")
    refs = spark.createDataFrame([("r", x) for x in ("main", "two", "none", "00abcdef", "-x", commit(5))], "repo string, ref string")
    got = {r.ref: (r.status, r.resolved) for r in gr.resolve_refs(refs, commits, names).collect()}
    assert got["main"] == got[commit(5)] == got["00abcdef"] == ("ok", commit(5))
    assert [got[x][0] for x in ("two", "none", "-x")] == ["ambiguous", "not_found", "invalid"]


def test_late_first_deliveries_stay(spark, tmp_path):
    src = str(tmp_path / "in")
    for day in (9, 1, 5):
        spark.createDataFrame([(f"d{day}", datetime(2024, 1, day)), ("d9", datetime(2024, 1, day))], "delivery_id string, received_at timestamp").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("delivery_id string, received_at timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    out = str(tmp_path / "out")
    se.drop_redeliveries(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.delivery_id for r in spark.read.parquet(out).collect()) == ["d1", "d5", "d9"]


def test_exports_keep_their_commits(spark, tmp_path):
    a, b = commit(1), commit(2)
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "1.txt").write_text(f"{a}\n\n3\t1\tx.py\n-\t-\ty.bin\n{b}\n1\t0\tz.py\n")
    got = {(r.full_hash, r.added, r.raw_path) for r in rd.read_commit_facts(spark, str(tmp_path / "n"), "numstat").collect()}
    assert got == {(a, "3", "x.py"), (a, "-", "y.bin"), (b, "1", "z.py")}
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "1.txt").write_text(f"commit {a}\ndiff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -3,2 +3 @@ f\n-p\n-q\n+r\n{b}\n--- a/y\n+++ b/y\n@@ -1 +0,0 @@\n-p\n")
    got = {(r.full_hash, r.path, r.old_start, r.old_count) for r in rd.read_commit_facts(spark, str(tmp_path / "d"), "diff").collect()}
    assert got == {(a, "x", 3, 2), (b, "y", 1, 1)}


def test_one_pass_metrics_equal_their_parts(spark):
    rows = [("m", i % 3 % 2, (i * 7 % 20) / 20) for i in range(60)] + [("n", 1, 0.5)]
    scored = spark.createDataFrame(rows, "model string, y int, p double")
    whole = {r.model: r.asDict() for r in ev.detailed_metrics(scored, ["model"], 0.35).collect()}
    for part in (ev.confusion(scored, ["model"], 0.35), ev.ranking_metrics(scored, ["model"]), ev.brier_score(scored, ["model"])):
        for r in part.collect():
            assert all(whole[r.model][k] == v for k, v in r.asDict().items())


def test_repeated_rows_and_null_groups_stay(spark):
    rows = [(r, datetime(2024, 1, 1 + i // 2), 1, "h", i % 3) for r in ("a", None) for i in range(10)]
    data = spark.createDataFrame(rows, "repo string, ts timestamp, seq long, full_hash string, extra int")
    split = ds.temporal_split(data).collect()
    assert len(split) == 20 and sorted((str(r.repo), r.position) for r in split) == sorted((g, i + 1) for g in ("a", "None") for i in range(10))
    labelled = spark.createDataFrame([("r", str(i), (1, 0, None)[i % 3]) for i in range(30)], "repo string, full_hash string, bug_introduced int")
    held = [r for r in ds.stratified_split(labelled, ["repo", "full_hash"]).collect() if r.split == "test"]
    assert len(held) == 6 and {r.bug_introduced for r in held} == {0, 1, None}
    scored = spark.createDataFrame([(m, i % 2, i / 10) for m in ("m", None) for i in range(9)], "model string, y int, p double")
    for out in (ev.ranking_metrics(scored, ["model"]), ev.probability_stats(scored, ["model"]), ev.detailed_metrics(scored, ["model"], 0.35)):
        a, b = (r.asDict() for r in out.collect())
        assert {a.pop("model"), b.pop("model")} == {"m", None} and a == b
