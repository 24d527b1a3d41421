"""Queries that run the event streams to completion and return the tables they leave.

The event rows are written as parquet files to the shared work folder and read back as a stream.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from changerisk.operators import events as ev, models as md
from changerisk.plans import q_features as qf
from changerisk.plans.adapters import with_adapters as wa
from changerisk.plans.catalog import ORACLES, query
from changerisk.plans.q_evaluation import BIAS, COEF, P_SCORED, SCALE, V_FEAT
from changerisk.plans.q_texts import P_EV, SECRET, event_rows
from changerisk.session import materialize, work_folder
from changerisk.streaming import events as se, keyed as ks

c = F.col


def _stream(t, files: int = 2):
    """The events as a stream of ``files`` micro-batches, and a folder for results.

    Each batch is a folder of as many files as its rows' tasks left.
    """
    folder = work_folder(t.spark)
    rows = event_rows(t).select("headers", "body", "received_at")
    rows.withColumn("batch", F.pmod(F.hash("received_at"), F.lit(files))).write.partitionBy("batch").parquet(f"{folder}/events")
    written = t.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{folder}/events").select("path").count()
    return se.read_event_stream(t.spark, f"{folder}/events/batch=*", -(-written // files)), folder


def _accepted(t):
    stream, folder = _stream(t)
    se.ingest_pr_events(stream, f"{folder}/accepted", f"{folder}/rejected", f"{folder}/ck", SECRET).awaitTermination()
    return t.spark.read.parquet(f"{folder}/accepted"), t.spark.read.parquet(f"{folder}/rejected"), folder


@query("st2_ingest_events", wa(["v_bodies"], """SELECT delivery_id, 'accepted' AS outcome, head_sha FROM ejudged WHERE reject_reason IS NULL
 UNION ALL SELECT delivery_id, reject_reason, '' FROM ejudged WHERE reject_reason IS NOT NULL""", P_EV))
def st2(t):
    good, bad, _ = _accepted(t)
    return good.select("delivery_id", F.lit("accepted").alias("outcome"), "head_sha").unionByName(
        bad.select("delivery_id", c("reject_reason").alias("outcome"), F.lit("").alias("head_sha"))
    )


@query("st3_drop_redeliveries", wa(["v_bodies"], "SELECT DISTINCT delivery_id FROM v_bodies"))
def st3(t):
    stream, folder = _stream(t, 8)
    named = stream.select(ev.header(c("headers"), "x-github-delivery").alias("delivery_id"), "received_at")
    se.drop_redeliveries(named).writeStream.format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").select("delivery_id")


@query("st4_report_upsert", wa(["v_bodies"], """SELECT owner, repository, CAST(json_extract_string(j, '$.pull_request.number') AS BIGINT) AS number, arg_max(concat('report for ', head_sha), ts) AS report FROM ejudged WHERE reject_reason IS NULL GROUP BY ALL""", P_EV))
def st4(t):
    stream, folder = _stream(t)
    good = ev.accepted(ev.classify_events(stream, SECRET).withColumn("at", c("received_at")))
    render = lambda b: b.withColumn("report", F.concat(F.lit("report for "), "head_sha"))
    se.report_stream(good, render, f"{folder}/log", f"{folder}/ck").awaitTermination()
    log = t.spark.read.schema(se.REPORT_LOG).parquet(f"{folder}/log")
    return se.latest_reports(log).select("owner", "repository", "number", "report")


@query("st5_stream_scoring", wa(["v_bodies", *V_FEAT], """SELECT e.head_sha, e.owner, CASE WHEN s.p IS NULL THEN NULL ELSE CAST(printf('%.4f', s.p) AS DOUBLE) END AS raw_probability FROM ejudged e LEFT JOIN scored s ON e.owner = 'own' AND e.repository = 'r1' AND s.full_hash = e.head_sha WHERE e.reject_reason IS NULL""", {**P_EV, **P_SCORED}))
def st5(t):
    stream, folder = _stream(t)
    good = ev.accepted(ev.classify_events(stream, SECRET))
    # Stored once: each micro-batch reads the table, not the way to it.
    static = materialize(qf.features(t).withColumn("repo", F.lit("own/r1")))
    scorer = lambda f: md.score_logistic(f, COEF, BIAS, SCALE)
    out = se.score_stream(good, static, scorer).select("head_sha", "owner", "raw_probability")
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").trigger(
        availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{folder}/out")


@query("st3_ledger", wa(["v_bodies"], "SELECT DISTINCT delivery_id FROM v_bodies"))
def st3_ledger(t):
    """First deliveries, told by a ledger beside the stream instead of by the stream's state."""
    stream, folder = _stream(t, 6)
    named = stream.select(ev.header(c("headers"), "x-github-delivery").alias("delivery_id"), "received_at")
    ledger = ks.delivery_ledger(t.spark, f"{folder}/ledger", buckets=4, compact_every=3)
    ks.redelivery_stream(named, ledger, f"{folder}/out", f"{folder}/ck").awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").select("delivery_id")


@query("st4_live_reports", ORACLES["st4_report_upsert"])
def st4_live(t):
    """Live reports from snapshots and deltas."""
    stream, folder = _stream(t, 4)
    good = ev.accepted(ev.classify_events(stream, SECRET).withColumn("at", c("received_at")))
    render = lambda b: b.withColumn("report", F.concat(F.lit("report for "), "head_sha"))
    table = ks.live_reports(t.spark, f"{folder}/live", buckets=4, compact_every=2)
    ks.live_report_stream(good, render, table, f"{folder}/ck").awaitTermination()
    return table.read().select("owner", "repository", "number", "report")


@query("st5_pruned_scoring", ORACLES["st5_stream_scoring"])
def st5_pruned(t):
    """Accepted events scored batch by batch, each with the folders of features that it needs."""
    stream, folder = _stream(t)
    good = ev.accepted(ev.classify_events(stream, SECRET))
    se.store_by_prefix(qf.features(t).withColumn("repo", F.lit("own/r1")), f"{folder}/features", 1)
    scorer = lambda f: md.score_logistic(f, COEF, BIAS, SCALE)
    columns = ["head_sha", "owner", "raw_probability"]
    se.score_batches(good, f"{folder}/features", scorer, f"{folder}/out", f"{folder}/ck", columns, 1).awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").select(*columns)
