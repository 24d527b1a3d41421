"""Features, labels, splits and order-dependent operators on small fixtures."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from changerisk.operators import dataset as ds, features as ft, labels as lb, ranges as rg, stats as st
from changerisk.operators.ordered import exact_medians, row_positions, running_totals
from changerisk.schema import FEATURES

COMMITS = "repo string, full_hash string, seq long, parents array<string>, subject string"


def test_commit_features_edge_cases(spark):
    commits = spark.createDataFrame(
        [("r", "rename", 1, ["p"], ""), ("r", "binary", 2, ["p"], ""), ("r", "empty", 3, ["p"], ""),
         ("r", "merge", 4, ["p", "q"], ""), ("r", "mixed", 5, ["p"], "")], COMMITS)
    files = spark.createDataFrame(
        [("r", "rename", "{a => b}/x.py", "0", "0"), ("r", "binary", "i.png", "-", "-"), ("r", "mixed", "src/a.py", "3", "2"),
         ("r", "mixed", "tests_dir/test_a.py", "90", "10"), ("r", "merge", "m.py", "1", "1")],
        "repo string, full_hash string, raw_path string, added string, deleted string")
    hunks = spark.createDataFrame([("r", "mixed")] * 3, "repo string, full_hash string")
    kept = ft.drop_merges(commits)
    got = {r.full_hash: r for r in ft.commit_features(kept, ft.parse_counts(files), hunks).collect()}
    assert set(got) == {"rename", "binary", "empty", "mixed"}
    assert (got["rename"].code_churn, got["rename"].files_changed) == (0, 1)
    assert (got["binary"].code_churn, got["binary"].files_changed, got["binary"].num_source_files_changed) == (0, 1, 0)
    assert [got["empty"][f] for f in FEATURES] == [0] * 10
    m = got["mixed"]
    assert (m.lines_added, m.lines_deleted, m.code_churn, m.avg_lines_changed_per_file) == (93, 12, 105, 52.5)
    assert (m.max_lines_changed_in_single_file, m.num_directories_touched, m.is_test_file_modified) == (100, 2, 1)
    assert (m.functions_changed, m.num_source_files_changed) == (3, 2)


def test_latest_n_keeps_newest_oldest_first(spark):
    rows = [("r", f"h{i}", i, [], "") for i in range(9)]
    got = ft.latest_n(spark.createDataFrame(rows, COMMITS), 3).orderBy("ordinal").collect()
    assert [(r.full_hash, r.ordinal) for r in got] == [("h6", 1), ("h7", 2), ("h8", 3)]


def test_label_scenario(spark):
    subjects = {"c1": "add app", "c2": "readme", "c3": "add utils", "f1": "Fix GH-42 calculation error", "f2": "Fix #88 issue in formatter",
                "cos": "fix docs typo", "rev": "Revert x", "rf": "Revert bug"}
    commits = spark.createDataFrame([("r", h, i, ["p"], s) for i, (h, s) in enumerate(subjects.items())], COMMITS)
    hunks = spark.createDataFrame(
        [("r", "f1", "p1", "app.py", 2, 2), ("r", "f2", "p2", "utils.py", 5, 1), ("r", "cos", "p1", "app.py", 1, 9),
         ("r", "f1", "p1", "app.py", 0, 3), ("r", "rev", "p1", "app.py", 1, 1), ("r", "rf", "p1", "app.py", 4, 6)],
        "repo string, full_hash string, parent string, path string, old_start long, old_count long")
    blame = spark.createDataFrame(
        [("r", "p1", "app.py", 1, 3, "c1"), ("r", "p1", "app.py", 4, 9, "f1"), ("r", "p2", "utils.py", 1, 9, "c3")],
        "repo string, rev string, path string, start_line long, end_line long, origin_sha string")
    ev = lb.trace_fixes(lb.fix_candidates(commits), hunks, blame)
    got = {r.full_hash: r for r in lb.label_commits(commits, ev).collect()}
    assert {h for h, r in got.items() if r.bug_introduced} == {"c1", "c3", "f1"}
    assert (got["c1"].label_confidence, got["c1"].fixing_issues, got["c1"].traced_lines_count) == ("HIGH", ["GH-42"], 2)
    assert (got["c3"].label_confidence, got["c3"].label_source) == ("MEDIUM", "szz_blame_traced")
    assert (got["f1"].label_source, got["f1"].fixing_commits) == ("revert_trace", ["rf"])
    assert (got["c2"].label_confidence, got["c2"].label_source, got["c2"].traced_lines_count) == ("NONE", "unlabeled_no_evidence", 0)


def test_overlap_join_and_exists_against_brute_force(spark):
    rng = random.Random(3)
    span = lambda: (lambda a: (a, a + rng.choice([0, 3, 40, 700])))(rng.randint(1, 2000))
    left = [(i, "hot" if i % 3 else f"k{i}", *span()) for i in range(150)]
    right = [(j, "hot" if j % 2 else f"k{j}", *span()) for j in range(150)]
    l = spark.createDataFrame(left, "i int, k string, a long, b long")
    r = spark.createDataFrame(right, "j int, k string, s long, e long")
    want = {(x[0], y[0]) for x in left for y in right if x[1] == y[1] and y[2] <= x[3] and y[3] >= x[2]}
    got = [(x.i, x.j) for x in rg.overlap_join(l, r, ["k"], ("a", "b"), ("s", "e"), 64).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    flags = {x.i: x.overlaps for x in rg.overlap_exists(l, r, ["k"], ("a", "b"), ("s", "e")).collect()}
    assert flags == {x[0]: any(p[0] == x[0] for p in want) for x in left}


def test_running_totals_with_a_hot_group(spark):
    rng = random.Random(5)
    rows = [("hot" if i < 400 else f"g{i % 7}", i, rng.randint(0, 9)) for i in range(600)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o long, v long")
    got = {(r.g, r.o): (r.s, r.s_total) for r in running_totals(df, ["g"], ["o"], {"s": "v"}).collect()}
    for g in {r[0] for r in rows}:
        part = sorted((o, v) for x, o, v in rows if x == g)
        upto = 0
        for o, v in part:
            upto += v
            assert got[(g, o)] == (upto, sum(x for _, x in part))
    pos = row_positions(df, ["g"], ["o"]).where("g = 'hot'").orderBy("o").collect()
    assert [r.position for r in pos] == list(range(1, 401))
    med = {r.g: r.median for r in exact_medians(df, ["g"], "v").collect()}
    assert med == {g: statistics.median(v for x, _, v in rows if x == g) for g in med}


def _dataset(spark, n=20):
    def values(i):
        return [float(i % 5) if f.startswith("avg") else i % 5 for f in FEATURES]

    rows = [("r", f"h{i}", i, 1000 + i // 2, *values(i), i % 2) for i in range(n)]
    cols = ", ".join(f"{f} {'double' if f.startswith('avg') else 'long'}" for f in FEATURES)
    return spark.createDataFrame(rows, f"repo string, full_hash string, seq long, ts long, {cols}, bug_introduced int")


def test_temporal_split_sizes_and_report(spark):
    parts = ds.temporal_split(_dataset(spark))
    counts = {r.split: r.n for r in parts.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert counts == {"train": 14, "validation": 3, "test": 3}
    rep = ds.split_report(parts).first()
    assert rep.checksum_valid and rep.total_overlap == 0 and rep.train_to_validation_ordered and rep.validation_to_test_ordered
    # 1,687 rows give the published split 1,181 / 253 / 253
    n = 1687
    sizes = [round(n * 0.70), round(n * 0.15)]
    big = ds.temporal_split(spark.range(n).select(F.lit("r").alias("repo"), F.col("id").alias("ts"), F.col("id").alias("seq"), F.col("id").cast("string").alias("full_hash")))
    got = {r.split: r["count"] for r in big.groupBy("split").count().collect()}
    assert [got["train"], got["validation"], got["test"]] == [*sizes, n - sum(sizes)] == [1181, 253, 253]


def test_chronology(spark):
    rows = [("a", i, f"h{i}", i) for i in range(50)] + [("b", i, f"h{i}", 0 if i == 30 else i) for i in range(50)]
    df = spark.createDataFrame(rows, "repo string, seq long, full_hash string, ts long")
    got = {r.repo: (r.falls, r.is_chronological) for r in ds.is_chronological(df, block_rows=7).collect()}
    assert got == {"a": (0, True), "b": (1, False)}


def test_scaler_uses_train_only_and_keeps_constants(spark):
    df = _dataset(spark).withColumn("lines_added", F.lit(7).cast("bigint"))
    train = df.where("seq < 10")
    scaler = st.scaler_values(train)
    changed = df.withColumn("code_churn", F.when(F.col("seq") >= 10, 10**6).otherwise(F.col("code_churn")))
    assert st.scaler_values(changed.where("seq < 10")) == scaler
    assert scaler["lines_added"] == (7.0, 1.0)
    vals = [i % 5 for i in range(10)]
    assert scaler["code_churn"] == pytest.approx((statistics.fmean(vals), statistics.pstdev(vals)))


def test_quality_report_counts_violations(spark):
    df = _dataset(spark).withColumn("code_churn", F.when(F.col("seq") == 0, 99).otherwise(F.col("lines_added") + F.col("lines_deleted")))
    df = df.withColumn("lines_added", F.when(F.col("seq") != 3, F.col("lines_added"))).withColumn("label_source", F.lit("x"))
    r = ds.quality_report(df).first()
    assert (r.total_rows, r.null_lines_added, r.churn_mismatches, r.leaked_columns) == (20, 1, 1, "label_source")


def test_feature_medians(spark, monkeypatch):
    """Ties, nulls, a null group, even and odd counts, one group with most of the rows."""
    import random
    import statistics

    from changerisk.operators import stats as st

    rng = random.Random(5)
    groups = ["big"] * 4000 + ["b"] * 7 + ["c"] * 2 + [None] * 40 + ["one", "none"]
    rows = [(g, None if g == "none" or rng.random() < 0.1 else rng.choice([0.0, 0.0, -1.5, rng.gauss(0, 9), 1e300]), rng.randrange(3)) for g in groups]
    df = spark.createDataFrame(rows, "g string, x double, y int")
    want = {}
    for g in set(groups):
        for i, f in enumerate("xy", 1):
            values = [r[i] for r in rows if r[0] == g and r[i] is not None]
            if values:
                want[g, f] = statistics.median(values)
    pick = lambda out: {(r.g, r.feature): r.median for r in out.collect()}
    assert pick(st.feature_medians(df, ["g"], ["x", "y"])) == want
    everywhere = {r.feature: r.median for r in st.feature_medians(df, [], ["x", "y"]).collect()}
    assert everywhere == {f: statistics.median([r[i] for r in rows if r[i] is not None]) for i, f in enumerate("xy", 1)}
    assert st.feature_medians(df.where("false"), ["g"], ["x", "y"]).count() == 0
    # Brackets that miss the middle: the values of those groups are ranked whole.
    monkeypatch.setattr(st, "BRACKET", (0.8, 0.9))
    assert pick(st.feature_medians(df, ["g"], ["x", "y"])) == want
