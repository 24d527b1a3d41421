"""Sources, sinks, model artefacts, events and streams."""

import hashlib
import hmac
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from changerisk.operators import events as ev, models as md
from changerisk.schema import EVENT_SOURCE, FEATURES, REPORT_SECTIONS
from changerisk.sources import readers as rd, writers as wr
from changerisk.streaming import events as se, keyed as ks

SECRET = "s3cret"
SHA = "a" * 40


def test_read_features(spark, tmp_path):
    head = ",".join([*FEATURES, "extra"])
    good, bad, short = tmp_path / "g.csv", tmp_path / "b.csv", tmp_path / "s.csv"
    good.write_text(head + "\n" + ",".join(["1"] * 7 + ["2.5", "3", "4", "z"]) + "\n")
    bad.write_text(head + "\n" + ",".join(["1"] * 6 + ["", "2.5", "3", "4", "z"]) + "\n")
    short.write_text("lines_added\n1\n")
    row = rd.read_features(spark, str(good)).first()
    assert row.lines_added == 1 and row.avg_lines_changed_per_file == 2.5 and row.extra == "z"
    with pytest.raises(rd.MissingValues, match="is_test_file_modified"):
        rd.read_features(spark, str(bad))
    with pytest.raises(ValueError, match="missing columns"):
        rd.read_features(spark, str(short))


def test_logs_with_bars(spark):
    lines = spark.createDataFrame(
        [("h1|Ann|2020-01-01T00:00:00Z|a | b|p1 p2",), ("h2|A|B|2020-01-01T00:00:00+01:00|plain|",), ("x|y|z",), ("",)], "value string")
    got = {r.full_hash: r for r in rd.parse_subject_log(lines).collect()}
    assert set(got) == {"h1", "h2"}
    assert (got["h1"].subject, got["h1"].parents, got["h1"].author) == ("a | b", ["p1", "p2"], "Ann")
    assert (got["h2"].subject, got["h2"].parents, got["h2"].author) == ("plain", [], "A|B")
    log = rd.parse_change_log(spark.createDataFrame([("h1|A|B|2020-01-01T00:00:00Z|p1",), ("h2|C|2020-01-01T00:00:00Z|",), ("h3|D",)], "value string"))
    assert [(r.full_hash, r.author, r.parents) for r in log.collect()] == [("h1", "A|B", ["p1"]), ("h2", "C", [])]


def test_report_reader_and_writer(spark, tmp_path):
    part = spark.createDataFrame([("m", 0.5)], "model string, pr_auc double")
    doc = wr.report_document(part, part, part, part)
    wr.write_text(doc, str(tmp_path / "report"))
    back = rd.read_report(spark, str(tmp_path / "report")).first()
    assert json.loads(back["benchmark_summary"]) == [{"model": "m", "pr_auc": 0.5}]
    for text, message in (("[1]", "not a JSON object"), (json.dumps({s: {} for s in REPORT_SECTIONS[1:]}), "metadata")):
        path = tmp_path / f"bad{len(text)}.json"
        path.write_text(text)
        with pytest.raises(ValueError, match=message):
            rd.read_report(spark, str(path))


def test_partitioned_dataset(spark, tmp_path):
    cols = ", ".join(f"{f} {'double' if f.startswith('avg') else 'long'}" for f in FEATURES)
    vals = [1.0 if f.startswith("avg") else 1 for f in FEATURES]
    rows = [("r", s, "h", "t", *vals, 1, "leak") for s in ("train", "test")]
    df = spark.createDataFrame(rows, f"repo string, split string, commit_hash string, commit_timestamp string, {cols}, bug_introduced int, label_source string")
    wr.write_dataset(df, str(tmp_path / "d"))
    back = spark.read.parquet(str(tmp_path / "d"))
    assert "label_source" not in back.columns and back.where("split = 'train'").count() == 1


def test_models_are_trained_and_production_is_kept(spark, tmp_path):
    rows = [(*[float(i + k) for k in range(10)], int(i > 30)) for i in range(60)]
    df = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in FEATURES) + ", bug_introduced int")
    model = md.forest(trees=5, depth=3).fit(df)
    path = str(tmp_path / "m")
    md.save_model(model, path, production=True)
    with pytest.raises(Exception, match="already exists"):
        md.save_model(model, path, production=True)
    a = md.positive_score(model, df, []).agg(F.sum("p")).first()[0]
    assert a == md.positive_score(md.load_model(path), df, []).agg(F.sum("p")).first()[0]
    assert md.model_weights(model, FEATURES, spark).agg(F.sum("weight")).first()[0] == pytest.approx(1.0)
    with pytest.raises(ValueError, match="missing"):
        md.assemble(df.drop("code_churn"))


def test_hmac_matches_the_standard_library(spark):
    bodies = [b"", b"{}", "é€".encode(), b"x" * 300]
    df = spark.createDataFrame([(b,) for b in bodies], "b binary")
    for secret in ("k", "long" * 40):
        got = [r[0] for r in df.select(ev.hmac_sha256(F.col("b"), secret)).collect()]
        assert got == [hmac.new(secret.encode(), b, hashlib.sha256).hexdigest() for b in bodies]


def payload(**kw):
    side = lambda: {"ref": "x", "sha": SHA, "repo": {"name": "r", "owner": {"login": "o"}}}
    pr = {"number": 5, "title": "t", "html_url": "u", "state": "open", "base": side(), "head": side()}
    pr.update(kw.pop("pr", {}))
    return json.dumps({"action": "opened", "pull_request": pr, **kw}).encode()


def event(body, kind="pull_request", delivery="d", sign=True, at=0):
    mac = hmac.new(SECRET.encode(), body, hashlib.sha256).hexdigest()
    headers = {"X-GitHub-Event": kind, "X-GitHub-Delivery": delivery}
    if sign is not None:
        headers["x-hub-signature-256"] = "sha256=" + (mac.upper() if sign else "0" * 64)
    return (headers, body, datetime(2024, 1, 1, 0, at))


def test_event_validation(spark):
    cases = [
        (event(payload()), None), (event(payload(), sign=None), "missing_signature"), (event(payload(), sign=False), "bad_signature"),
        (event(b""), "bad_signature"), (event(payload(), kind="push"), "unsupported_event"), (event(b"{oops"), "malformed_json"), (event(b"[]"), "not_object"),
        (event(payload(action="closed")), "unsupported_action"), (event(payload(pull_request=None)), "missing_pull_request"),
        (event(payload(pr={"state": "closed"})), "not_open"), (event(payload(pr={"number": "5"})), "invalid_number"), (event(payload(pr={"number": 0})), "invalid_number"),
        (event(payload(pr={"base": {"sha": "abc", "repo": {"name": "r", "owner": {"login": "o"}}}})), "invalid_base_sha"),
        (event(payload(pr={"base": {"sha": SHA}})), None), (event(payload(pr={"base": {"sha": SHA, "repo": {"name": "a b", "owner": {"login": "o"}}}})), "invalid_repository"),
    ]
    rows = [(*e, i) for i, (e, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "headers map<string,string>, body binary, received_at timestamp, i int")
    got = {r.i: r for r in ev.classify_events(df, SECRET).collect()}
    assert [got[i].reject_reason for i in range(len(cases))] == [w for _, w in cases]
    assert (got[0].owner, got[0].repository, got[0].number, got[0].delivery_id) == ("o", "r", 5, "d")
    assert got[13].owner == "o"
    assert {r.reject_reason for r in ev.classify_events(df.where("i = 2"), None).collect()} == {None}


def test_streams_equal_batch_and_upserts_repeat_safely(spark, tmp_path):
    first = [event(payload(pr={"number": n}), at=n) for n in (1, 2)] + [event(b"[]")]
    second = [event(payload(pr={"number": n, "head": {"sha": "b" * 40}}), at=10 + n) for n in (2, 3)]
    src = str(tmp_path / "in")
    for part in (first, second):
        spark.createDataFrame(part, EVENT_SOURCE).coalesce(1).write.mode("append").parquet(src)
    stream = se.read_event_stream(spark, src, 1)
    se.ingest_pr_events(stream, str(tmp_path / "ok"), str(tmp_path / "no"), str(tmp_path / "ck1"), SECRET).awaitTermination()
    whole = ev.classify_events(spark.read.parquet(src), SECRET)
    assert spark.read.parquet(str(tmp_path / "ok")).count() == ev.accepted(whole).count() == 4
    assert spark.read.parquet(str(tmp_path / "no")).count() == 1

    log = str(tmp_path / "log")
    batch = lambda part: ev.accepted(
        ev.classify_events(spark.createDataFrame(part, EVENT_SOURCE).withColumn("received", F.col("received_at")), SECRET)
    ).withColumn("report", F.concat(F.lit("r "), F.substring("head_sha", 1, 1)))
    se.upsert_reports(batch(first), 0, log)
    for _ in range(2):  # the second batch is delivered twice
        se.upsert_reports(batch(second), 1, log)
    live = {r.number: (r.report, r.action) for r in se.latest_reports(spark.read.schema(se.REPORT_LOG).parquet(log)).collect()}
    assert live == {1: ("r a", "created"), 2: ("r b", "updated"), 3: ("r b", "created")}


def parquet_bytes(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_ledger_tells_redeliveries_of_any_age(spark, tmp_path):
    ledger = ks.delivery_ledger(spark, str(tmp_path / "ledger"), buckets=3, compact_every=4)
    ledger.create()
    batches = [[(f"d{k}", datetime(2024, 1, 1 + k)), (f"d{k}", datetime(2024, 2, 1)), (None, datetime(2024, 1, 1))] for k in range(11)]
    batches[10] += [("d0", datetime(2024, 3, 1)), ("d9", datetime(2024, 3, 1))]
    for k, rows in enumerate(batches):
        for _ in range(2 if k in (3, 4, 10) else 1):  # some batches run twice, one of them after its snapshot
            ks.first_deliveries(spark.createDataFrame(rows, "delivery_id string, received_at timestamp"), k, ledger, str(tmp_path / "out"))
    got = [(r.delivery_id, r.received_at) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(x for x in got if x[0]) == sorted((f"d{k}", datetime(2024, 1, 1 + k)) for k in range(11))
    assert sum(x[0] is None for x in got) == 11 and ledger.upto() == 7
    assert ledger.read().count() == 11 and ledger.read([0]).count() + ledger.read([1, 2]).count() == 11


def test_live_reports_survive_replays_and_do_not_grow(spark, tmp_path):
    table = ks.live_reports(spark, str(tmp_path / "live"), buckets=2, compact_every=3)
    table.create()
    table.create()
    ddl = "owner string, repository string, number long, report string, received_at timestamp, delivery_id string"
    read = []
    for k in range(9):
        rows = [("o", "r", n, f"{k}:{n}", datetime(2024, 1, 1 + k), "x") for n in range(k % 2, 6)] + [("o", None, 1, "late", datetime(2023, 1, 1), "x")]
        for _ in range(2):
            table.upsert(spark.createDataFrame(rows, ddl), k)
        now = table.upto()
        read.append(parquet_bytes(tmp_path / "live" / "snapshots" / f"upto={now}") + parquet_bytes(tmp_path / "live" / "deltas" / f"after={now}"))
    live = {(r.repository, r.number): (r.report, r.first_batch, r.last_batch) for r in table.read().collect()}
    assert live == {("r", n): (f"8:{n}", 0, 8) for n in range(6)} | {(None, 1): ("late", 0, 8)}
    assert read[8] <= read[2] * 1.2 and read[7] <= read[4] * 1.2


def test_stream_with_a_ledger_goes_on_after_a_stop(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    ledger = ks.delivery_ledger(spark, str(tmp_path / "ledger"), buckets=2, compact_every=2)
    for part in ([1, 2], [2, 3]), ([1, 4], [3, 5, 5]):
        for ids in part:
            spark.createDataFrame([(f"d{i}", datetime(2024, 1, i)) for i in ids], "delivery_id string, received_at timestamp").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("delivery_id string, received_at timestamp").option("maxFilesPerTrigger", 1).parquet(src)
        query = ks.redelivery_stream(stream, ledger, out, str(tmp_path / "ck"))
        query.awaitTermination()
        assert all(not p.stateOperators for p in query.recentProgress)
    assert sorted(r.delivery_id for r in spark.read.parquet(out).collect()) == [f"d{i}" for i in range(1, 6)]


def test_exports_are_read_in_splits(spark, tmp_path):
    shas = [f"{k:040x}" for k in range(60)]
    stat = ["not\tof\tany"] + [x for k, h in enumerate(shas) for x in (f"commit {h}" if k % 2 else h, "", *[f"{k}\t{i}\tdir/f{i}.py" for i in range(k % 9)])]
    diff = ["@@ -1 +1 @@"] + [x for k, h in enumerate(shas) for x in (h, "@@ -7 +7 @@ before a file", *[y for i in range(k % 5) for y in (f"--- a/f {i}.py", "+++ b/x", f"@@ -{k + 1},{i} +1 @@", "-gone" * 30, f"@@ -{k + 9} +1 @@")], "--- /dev/null", "@@ -3 +3 @@")]
    for name, lines in (("stat", stat), ("diff", diff)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "1.txt").write_text("\n".join(lines) + "\n")
    want_stat = sorted((h, str(k), str(i), f"dir/f{i}.py") for k, h in enumerate(shas) for i in range(k % 9))
    want_diff = sorted([(h, f"f {i}.py", k + 1, i) for k, h in enumerate(shas) for i in range(1, k % 5)] + [(h, f"f {i}.py", k + 9, 1) for k, h in enumerate(shas) for i in range(k % 5)])
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for split in ("1024b", size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0" if split != size else "4194304")
        try:
            if split != size:
                assert spark.read.text(str(tmp_path / "diff")).rdd.getNumPartitions() > 10
            assert sorted(tuple(r) for r in rd.read_numstat_export(spark, str(tmp_path / "stat")).collect()) == want_stat
            assert sorted((r.full_hash, r.path, r.old_start, r.old_count) for r in rd.read_diff_export(spark, str(tmp_path / "diff")).collect()) == want_diff
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "4194304")


def test_a_batch_reads_the_folders_it_needs(spark, tmp_path):
    path = str(tmp_path / "features")
    hashes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(400)] + ["00" + "1" * 38, "0e" + "1" * 38]
    se.store_by_prefix(spark.createDataFrame([("o/r", h, float(i)) for i, h in enumerate(hashes)], "repo string, full_hash string, x double"), path)
    heads = spark.createDataFrame([(h,) for h in (hashes[3], hashes[3], hashes[7], "00" + "1" * 38, "ff" * 20, None)], "head_sha string")
    found = se.features_of(heads, path)
    folders = {f.split("prefix=")[1][:2] for f in found.inputFiles()}
    assert {r.full_hash[:2] for r in found.collect()} == {h[:2] for h in (hashes[3], hashes[7], "00", "ff")} & {h[:2] for h in hashes}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [prefix" in plan and len(folders) > 100
    got = {(r.head_sha, r.x) for r in se.score_stream(heads.withColumns({"owner": F.lit("o"), "repository": F.lit("r")}), found, lambda f: f).collect()}
    assert got == {(hashes[3], 3.0), (hashes[7], 7.0), ("00" + "1" * 38, 400.0), ("ff" * 20, None), (None, None)}
