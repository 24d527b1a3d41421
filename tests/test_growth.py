"""What keeps the moved bytes small: inputs worked out once, joins on numbers, the same rows as before."""

import pytest
from pyspark.sql import functions as F

from changerisk.operators import context as cx, dataset as ds, diffs as df_, features as ft, labels as lb, provenance as pv, reviews as rv
from changerisk.plans import adapters as ad, q_features as qf
from changerisk.session import materialize
from changerisk.sources import readers as rd

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_split_does_not_work_its_input_out_again(spark, tmp_path):
    rows = [("r", i if i % 7 else None, i, f"h{i}") for i in range(40)] + [(None, 1, 1, "x"), (None, None, 2, "y")]
    spark.createDataFrame(rows, "repo string, ts long, seq long, full_hash string").write.parquet(f"{tmp_path}/in")
    out = ds.temporal_split(spark.read.parquet(f"{tmp_path}/in"))
    assert not [f for f in out.inputFiles() if str(tmp_path) in f]
    got = {(r.repo, r.seq): (r.position, r.split) for r in out.collect()}
    assert len(got) == len(rows)
    dated = [i for i in range(40) if i % 7]
    assert [got["r", i][0] for i in dated] == list(range(1, len(dated) + 1))
    assert [got["r", i][1] for i in dated] == ["train"] * 24 + ["validation"] * 5 + ["test"] * 5
    assert {got["r", i] for i in range(0, 40, 7)} == {(None, "undated")}
    assert got[None, 1] == (1, "train") and got[None, 2] == (None, "undated")


@pytest.mark.parametrize("name", ["v_changes", "v_hunks", "v_blame_runs"])
def test_line_items_meet_orders_by_number(spark, name):
    t = ad.Tables(spark, SMALL)
    frame = getattr(t, name)
    assert "md5(cast(l_orderkey" not in plan(frame)
    text = ",\n".join(f"{n} AS ({ad.ADAPTERS[n]})" for n in ad.needed([name]))
    by_hash = spark.sql(f"WITH {text}\nSELECT * FROM {name}")
    assert frame.columns == by_hash.columns and frame.count() == by_hash.count()
    assert frame.exceptAll(by_hash).isEmpty()


def test_numbered_features_and_targets_are_those_of_the_hashes(spark):
    t = ad.Tables(spark, SMALL)
    by_hash = ft.commit_features(t.v_commits, ft.parse_counts(t.v_changes), t.v_hunks)
    numbered = qf.features(t)
    assert numbered.columns == by_hash.columns and numbered.count() == by_hash.count()
    assert numbered.exceptAll(by_hash).isEmpty()
    wanted = qf.labels(t).where("bug_introduced = 1").select("repo", "seq")
    got = qf.targets(t).select("repo", "seq")
    assert got.count() == wanted.count() > 0 and got.exceptAll(wanted).isEmpty()


def test_introducing_commits_leave_out_own_lines(spark):
    hunks = spark.createDataFrame([("r", "f1", "v", "p", 3, 2), ("r", "f2", "v", "p", 9, 1), ("r", "f2", "v", "p", 0, 4)],
                                  "repo string, full_hash string, parent string, path string, old_start long, old_count long")
    runs = spark.createDataFrame([("r", "v", "p", 1, 3, "a"), ("r", "v", "p", 4, 8, "f1"), ("r", "v", "p", 9, 9, "a"), ("r", "w", "p", 1, 9, "b")],
                                 "repo string, rev string, path string, start_line long, end_line long, origin_sha string")
    assert [tuple(r) for r in lb.introducing_commits(hunks, runs).collect()] == [("r", "a", 1)]
    assert lb.introducing_commits(hunks, runs.where(F.lit(False))).isEmpty()


def _random_history(spark, revisions, seed):
    """Hunks of a few files, and for each deleted line of each revision the revision that wrote it."""
    import random

    rnd, rows, want = random.Random(seed), [], set()
    for name, n in revisions.items():
        text = []
        for rev in range(1, n + 1):
            cut = [] if rev == 1 else sorted(rnd.sample(range(0, max(len(text) - 4, 1), 5), min(rnd.randint(1, 3), max(len(text) // 5, 1))))
            out, at = ([(rev, i) for i in range(40)], 0) if rev == 1 else ([], 0)
            if rev == 1:
                rows.append((name, rev, 0, 0, 1, 40))
            for start in cut:
                old, new = rnd.randint(0, 3), rnd.randint(1, 3)
                out += text[at:start]
                gone = text[start : start + old]
                rows.append((name, rev, start + 1 if gone else start, len(gone), len(out) + 1, new))
                want |= {(name, rev, start + 1 + i, line[0]) for i, line in enumerate(gone)}
                out, at = out + [(rev, i) for i in range(new)], start + len(gone)
            text = out + text[at:] if rev > 1 else out
    hunks = spark.createDataFrame(rows, "lineage string, rev_no long, old_start long, old_count long, new_start long, new_count long")
    return hunks.withColumns({"repo": F.lit("r"), "full_hash": F.concat_ws("-", "lineage", "rev_no")}), want


@pytest.mark.parametrize("most", [0, 45, 512])
def test_short_and_long_files_have_the_same_origins(spark, monkeypatch, most):
    history, want = _random_history(spark, {"a": 33, "b": 9, "c": 1}, most)
    monkeypatch.setattr(pv, "SHORT_HUNKS", most)
    stored = []
    monkeypatch.setattr(pv, "materialize", lambda df: stored.append(1) or materialize(df))
    runs = pv.fix_origins(history, history.select("repo", "full_hash"))
    lines = runs.select("lineage", F.split("full_hash", "-")[1].cast("int").alias("fix"), F.explode(F.sequence("start_line", "end_line")).alias("line"),
                        F.split("origin_sha", "-")[1].cast("int").alias("origin"))
    got = [tuple(r) for r in lines.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert most < 512 or len(stored) <= 1


DIFF = "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1 +1,2 @@ f\n-x\n+y\r+@@ -3 +3 @@\n+z\x1c@@ -5 +9 @@ g\n+w\u2028@@ -7,2 +8 @@\n-v\ndiff --git a/b b/b\nnew file mode 1\n"


def _files(spark):
    texts = spark.createDataFrame([("r", "h", DIFF), ("r", "i", "")], "repo string, full_hash string, diff_text string")
    return texts, df_.classify_files(df_.split_diff_files(texts))


def cuts(df):
    """How often a plan cuts texts at their hunk headers."""
    return plan(df).count("(?=@@ -")


def test_commit_document_cuts_its_texts_once(spark):
    texts, files = _files(spark)
    nested = df_.assemble_commit_diff(texts, df_.match_numstat(files))
    assert cuts(nested) == 1
    rows = {r.full_hash: r for r in nested.collect()}
    assert (rows["h"]["files"], rows["h"].total_additions, rows["h"].total_deletions, len(rows["h"].files_changed)) == (2, 4, 2, 2)
    assert [(h.old_start, h.new_start, len(h.lines)) for h in rows["h"].files_changed[0].hunks] == [(1, 1, 4), (5, 9, 1), (7, 8, 1)]
    assert rows["i"].is_empty_commit and rows["i"].files_changed is None and "files_changed" not in rows["i"].json


def test_line_ranges_cut_their_texts_once(spark):
    extents = rv.hunk_extents(_files(spark)[1])
    assert cuts(extents) == 1
    assert sorted((r.first_line, r.last_line) for r in extents.collect()) == [(1, 1), (1, 3), (5, 5), (7, 8), (8, 8), (9, 9)]


def test_lines_of_files_cut_their_texts_once(spark):
    texts = rv.file_contents(_files(spark)[1]).where(F.size("contents") > 0)
    assert cuts(texts) == 1
    assert [r.contents for r in texts.collect()] == [["x", "y", "@@ -3 +3 @@", "z", "w", "v"]]


def test_context_stores_its_texts_once(spark):
    texts, files = _files(spark)
    commits = texts.select("repo", "full_hash", *[F.lit("x").alias(x) for x in ("author", "commit_timestamp", "subject")])
    out = cx.build_review_context(commits, cx.file_text(df_.match_numstat(files)), 2**31 - 1)
    assert cuts(out) == 0
    rows = {r.full_hash: r for r in out.collect()}
    assert "+++ a.py\nf\n-x\n+y\n+@@ -3 +3 @@\n+z\ng\n+w\n\n-v\n" in rows["h"].context and "No files changed." in rows["i"].context


def test_exports_store_the_lines_asked_for(spark, tmp_path):
    part = "--- a/f{0}\n+++ b/f\n@@ -{0},2 +5 @@ x\n-a\n@@ -5,0 +6,2 @@\n+c\n--- /dev/null\n@@ -0,0 +1 @@\n@@ -9 +9 @@"
    lines = [x for k in range(9) for x in (f"commit {k:040x}", *part.format(k).split("\n"))]
    (tmp_path / "1.txt").write_text("\n".join(lines) + "\n")
    out = rd.read_diff_export(spark, str(tmp_path))
    assert plan(out).count("Window") == 1
    stored = spark.read.parquet(*out.inputFiles())
    # Two headers a commit delete lines, and the split has a row of its own.
    assert stored.count() == 2 * 9 + 1
    assert sorted((r.full_hash, r.path, r.old_start, r.old_count) for r in out.collect()) == [(f"{k:040x}", f"f{k}", k, 2) for k in range(9)]


def test_detected_renames_read_every_document(spark):
    """Documents of any length are files of the commits, as in the SQL."""
    from types import SimpleNamespace

    from changerisk.plans import q_graph as qg
    from changerisk.plans.catalog import ORACLES

    texts = [(i, " ".join(f"w{i}x{j}" for j in range(n))) for i, n in ((1, 3), (2, 2000), (61, 900), (63, 5), (60, 3000))]
    t = SimpleNamespace(spark=spark, documents=spark.createDataFrame(texts, "doc_id long, text string"))
    assert {r.path for r in qg.contents(t).collect()} == {"old/1.txt", "old/2.txt", "old/61.txt", "old/60.txt", "new/1.txt", "new/2.txt", "new/61.txt", "new/63.txt"}
    # 1 and 61 stand in one commit and keep four fifths of their text; 2 keeps too little, 60 and 63 are on one side only.
    assert sorted((r.full_hash, r.mutual_best) for r in qg.g5_renames(t).collect()) == [("k1", 2)]
    assert "length(text) <" not in ORACLES["g5_detected_renames"]


@pytest.mark.parametrize("most", [25, 128])
def test_short_and_long_histories_with_merges_have_the_same_origins(spark, monkeypatch, most):
    """A repository is one row or followed chain by chain; repo "b" is exported out of order."""
    from test_graph import first_writer, merged_history

    nodes, edges, hunks, asked, want = [], [], [], [], {}
    for repo, seed, n in (("a", 5, 30), ("b", 6, 20), ("c", 7, 20)):
        parents, texts, found = merged_history(seed, n)
        nodes += [(repo, f"{i}", -i if repo == "b" else i) for i in parents]
        edges += [(repo, f"{i}", f"{p}", o) for i, ps in parents.items() for o, p in enumerate(ps)]
        hunks += [(repo, name, f"{i}", o, *h) for (i, o), rows in found.items() for h in rows for name in ("f", "g")]
        asked += [(repo, name, f"{i}", i, 1, len(text)) for i, text in texts.items() if text for name in ("f", "g")]
        want |= {(repo, name, i, k): str(first_writer(parents, found, i, k)) for i, text in texts.items() for k in range(1, len(text) + 1) for name in ("f", "g")}
    # A first and a side parent outside the export: lines end at the one, the other takes none.
    nodes.append(("d", "x", 1))
    edges += [("d", "x", "gone", 0), ("d", "x", "lost", 1)]
    hunks.append(("d", "f", "x", 0, 1, 1, 2, 1))
    asked.append(("d", "f", "x", 0, 1, 3))
    want["d", "f", 0, 2] = "x"
    frames = [spark.createDataFrame(rows, ddl) for rows, ddl in (
        (hunks, "repo string, lineage string, full_hash string, parent_ord int, old_start long, old_count long, new_start long, new_count long"),
        (nodes, "repo string, full_hash string, seq long"), (edges, "repo string, child string, parent string, parent_ord int"),
        (asked, "repo string, lineage string, full_hash string, i long, start_line long, end_line long"))]
    stored = []
    monkeypatch.setattr(pv, "SHORT_REVISIONS", most)
    monkeypatch.setattr(pv, "materialize", lambda df: stored.append(1) or materialize(df))
    lines = {}
    for r in pv.provenance_across_merges(*frames, ["i"]).collect():
        for k in range(r.start_line, r.end_line + 1):
            assert (r.repo, r.lineage, r.i, k) not in lines
            lines[r.repo, r.lineage, r.i, k] = r.origin_sha
    assert lines == want
    short = [rows.where("repo in ('a', 'c', 'd')") for rows in frames]
    stored.clear()
    assert pv.provenance_across_merges(*short, ["i"]).count() > 0
    # Short histories need no rounds: three small tables are stored.
    assert most < 30 or len(stored) == 3


def test_detected_renames_search_once_and_rank_as_the_sql(spark, monkeypatch):
    """Equal texts in one commit: both files of a pair must rank it first, and the texts are searched once."""
    from types import SimpleNamespace

    from changerisk.operators import renames as rn
    from changerisk.plans import q_graph as qg

    rows = [("r", "k", f"old/{i}", "D", "x\ny z") for i in (1, 2)] + [("r", "k", f"new/{i}", "A", "x\ny z") for i in (2, 3)]
    rows += [("r", "k", "old/7", "D", "b\na"), ("r", "k", "new/8", "A", "a\nb"), ("r", "k", "new/9", "A", "b\na")]
    table = spark.createDataFrame(rows, "repo string, full_hash string, path string, status string, content string")
    stored, kept = [], rn.materialize
    monkeypatch.setattr(rn, "materialize", lambda df: stored.append(df.columns) or kept(df))
    monkeypatch.setattr(qg, "contents", lambda t, *sql: table)
    # old/1 prefers new/2, which prefers old/2; old/7 prefers new/8, the first of two with all its lines.
    assert [(r.mutual_best, r.shares) for r in qg.g5_renames(SimpleNamespace()).collect()] == [(2, 2.0)]
    assert sum("content" in c for c in stored) == 1
    best = rn.mutual_best(rn.rename_candidates(table))
    assert {(r.old_path, r.path) for r in best.collect()} == {("old/2", "new/2"), ("old/7", "new/8")}


def test_rename_search_keeps_pairs_of_unlike_sizes(spark):
    """Every pair of at least the share is found, however the common lines lie in the order of rarity."""
    import random

    from test_graph import common_share

    from changerisk.operators import renames as rn

    rnd = random.Random(4)
    words = [f"w{i}" * rnd.randint(1, 6) for i in range(60)]
    text = lambda: "\n".join(words[min(int(rnd.expovariate(0.07)), 59)] for _ in range(rnd.randint(2, 40)))
    rows = [("r", f"k{i % 2}", f"{s}/{i}", s, text()) for s in "DA" for i in range(60)]
    found = rn.rename_candidates(spark.createDataFrame(rows, "repo string, full_hash string, path string, status string, content string"))
    got = {(r.full_hash, r.old_path, r.path): r.share for r in found.collect()}
    want = {(o[1], o[2], a[2]): common_share(o[4], a[4]) for o in rows for a in rows if o[1] == a[1] and (o[3], a[3]) == ("D", "A")}
    want = {k: v for k, v in want.items() if v >= 0.5}
    assert got.keys() == want.keys() and len(want) > 20 and all(abs(got[k] - v) < 1e-12 for k, v in want.items())


def test_labels_from_hunks_number_their_items_once(spark, monkeypatch):
    """Commits, changes and hunks come out of one stored numbering; hunks have their paths without a join."""
    from changerisk.plans import q_graph as qg

    seen = []
    monkeypatch.setattr(qg.lb, "trace_fixes_in_history", lambda *rows: seen.extend(rows) or (_ for _ in ()).throw(InterruptedError))
    with pytest.raises(InterruptedError):
        qg.e1(ad.Tables(spark, SMALL))
    assert len(seen) == 3
    for rows in seen:
        assert "Window" not in plan(rows) and "Join" not in plan(rows) and not [f for f in rows.inputFiles() if "lineitem" in f]
    keys = ["repo", "full_hash", "path"]
    assert seen[2].select(keys).exceptAll(seen[1].select(keys)).isEmpty() and seen[2].count() == seen[1].count() > 0


@pytest.mark.parametrize("name", ["v_graph", "v_nodes", "v_edges", "v_prs"])
def test_graph_moves_order_numbers(spark, name):
    """The graph's windows hold no hashes, and once stored it is not worked out again; its rows are those of the SQL."""
    t = ad.Tables(spark, SMALL)
    frame = getattr(t, name)
    text = ",\n".join(f"{n} AS ({ad.ADAPTERS[n]})" for n in ad.needed([name]))
    by_hash = spark.sql(f"WITH {text}\nSELECT * FROM {name}")
    assert all("md5" not in line for line in plan(frame).split("\n") if "Window" in line) and "Window" in plan(frame)
    t.store_graph()
    stored = getattr(t, name)
    assert "Window" not in plan(stored) and not [f for f in stored.inputFiles() if "orders" in f]
    for rows in (frame, stored):
        assert rows.columns == by_hash.columns and rows.count() == by_hash.count() and rows.exceptAll(by_hash).isEmpty()
