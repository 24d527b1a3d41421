"""Queries that write with a sink, read back with a source and return what came back."""

from __future__ import annotations

from pyspark.sql import functions as F

from changerisk.operators import evaluation as ev, events as es, models as md
from changerisk.plans import q_features as qf
from changerisk.plans.adapters import with_adapters as wa
from changerisk.plans.catalog import query
from changerisk.plans.q_evaluation import G, V_FEAT
from changerisk.plans.q_streaming import _stream
from changerisk.schema import FEATURES, REPORT_SECTIONS
from changerisk.session import materialize, work_folder
from changerisk.sources import readers as rd, writers as wr

c = F.col
WHOLE = [f for f in FEATURES if not f.startswith("avg_")]


@query("s1_read_features", wa(V_FEAT, "SELECT repo, count(*) AS rows, " + ", ".join(f"CAST(sum({f}) AS BIGINT) AS {f}" for f in WHOLE) + " FROM feat GROUP BY repo", qf.P_FEAT))
def s1(t):
    """Sums per repository of a feature table that was written as CSV and read back with its checks."""
    path = f"{work_folder(t.spark)}/features.csv"
    qf.features(t).select("repo", "full_hash", *FEATURES).write.option("header", True).csv(path)
    table = rd.read_features(t.spark, path)
    return table.groupBy("repo").agg(F.count("*").alias("rows"), *[F.sum(f).cast("bigint").alias(f) for f in WHOLE])


@query("s6_read_report", wa(["v_scored"], "SELECT section, CAST(items AS INT) AS items FROM (" + " UNION ALL ".join(
    f"SELECT '{name}' AS section, count(*) AS items FROM (SELECT DISTINCT {keys} FROM v_scored)" for name, keys in zip(REPORT_SECTIONS, ("split", "model, split", "model, split", "model, split"), strict=True)) + ")"))
def s6(t):
    """Entries of each section of a report document that was written and read back."""
    folder = work_folder(t.spark)
    metrics = materialize(ev.detailed_metrics(t.v_scored, G, 0.35))
    ranked = metrics.select("model", "split", "pr_auc")
    facts = metrics.groupBy("split").agg(F.sum("total_samples").alias("rows"))
    wr.write_text(wr.report_document(facts, ranked, metrics, ranked), f"{folder}/report")
    report = rd.read_report(t.spark, f"{folder}/report")
    return report.unpivot([], report.columns, "section", "content").select("section", F.json_array_length("content").alias("items"))


@query("s7_partitioned_dataset", wa(qf.V_ALL, "SELECT repo, split, count(*) AS rows, CAST(sum(code_churn) AS BIGINT) AS churn, CAST(sum(bug_introduced) AS BIGINT) AS positives FROM splits GROUP BY repo, split", qf.P_SPLIT))
def s7(t):
    folder = work_folder(t.spark)
    rows = qf.splits(t).withColumn("commit_timestamp", c("ts").cast("string"))
    wr.write_dataset(rows, f"{folder}/dataset")
    back = t.spark.read.parquet(f"{folder}/dataset")
    return back.groupBy("repo", "split").agg(
        F.count("*").alias("rows"), F.sum("code_churn").alias("churn"), F.sum("bug_introduced").cast("bigint").alias("positives")
    )


@query("s9_model_store", wa(qf.V_ALL, "SELECT repo, full_hash, bug_introduced AS y, true AS same FROM splits WHERE split = 'test'", qf.P_SPLIT))
def s9(t):
    """A stored and reloaded model scores every commit of the test split as the fitted one does."""
    folder = work_folder(t.spark)
    parts = materialize(qf.splits(t))
    fitted = md.forest(**md.FOREST_GRID[0]).fit(parts.where("split = 'train'"))
    md.save_model(fitted, f"{folder}/model", production=True)
    test, keys = parts.where("split = 'test'"), ["repo", "full_hash"]
    again = md.positive_score(md.load_model(f"{folder}/model"), test, keys)
    first = md.positive_score(fitted, test, keys).select(*keys, c("p").alias("q"))
    return again.join(first, keys).select(*keys, c("y").cast("int").alias("y"), (c("p") == c("q")).alias("same"))


@query("s10_event_source", wa(["v_bodies"], "SELECT delivery_id, event_type, CAST(strlen(body_text) AS BIGINT) AS body_bytes FROM v_bodies"))
def s10(t):
    stream, folder = _stream(t)
    out = stream.select(
        es.header(c("headers"), "x-github-delivery").alias("delivery_id"), es.header(c("headers"), "x-github-event").alias("event_type"),
        F.octet_length("body").cast("bigint").alias("body_bytes"),
    )
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").trigger(
        availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{folder}/out")


# One text per order: its hash and its items as numstat lines, or as a zero-context diff.
def _exported(t, name, columns, line, before=""):
    folder = work_folder(t.spark)
    key = c("l_orderkey").cast("string")
    # Items meet as numbers, their lines are written after that.
    items = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", *columns))).alias("items"))
    texts = items.select("l_orderkey", F.array_join(F.transform("items", line), "\n").alias("body"))
    own = F.sha1(key)
    wr.write_text(texts.select(F.concat(F.lit(before), own, F.lit("\n"), "body").alias("value")), f"{folder}/{name}")
    return f"{folder}/{name}"


@query("s4_numstat_export", "SELECT sha1(CAST(l_orderkey AS VARCHAR)) AS full_hash, CASE WHEN l_linenumber % 4 = 0 THEN '-' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS added, CASE WHEN l_linenumber % 4 = 0 THEN '-' ELSE CAST(l_linenumber AS VARCHAR) END AS deleted, concat('src/f ', CAST(l_partkey AS VARCHAR), '.py') AS raw_path FROM lineitem")
def s4_export(t):
    """Numstat exports written as files and read in splits."""
    def line(x):
        binary = x["l_linenumber"] % 4 == 0
        return F.concat_ws(
            "\t", F.when(binary, "-").otherwise(x["l_quantity"].cast("bigint").cast("string")), F.when(binary, "-").otherwise(x["l_linenumber"].cast("string")),
            F.concat(F.lit("src/f "), x["l_partkey"].cast("string"), F.lit(".py")),
        )

    return rd.read_numstat_export(t.spark, _exported(t, "numstat", ["l_quantity"], line))


@query("s5_diff_export", "SELECT sha1(CAST(l_orderkey AS VARCHAR)) AS full_hash, concat('f', CAST(l_suppkey AS VARCHAR), '.py') AS path, l_partkey AS old_start, CAST(l_linenumber AS BIGINT) AS old_count, CAST(5 AS BIGINT) AS new_start, CAST(1 AS BIGINT) AS new_count FROM lineitem")
def s5_export(t):
    """Zero-context diff exports written as files and read in splits."""
    line = lambda x: F.concat(
        F.lit("diff --git a/x b/x\n--- a/f"), x["l_suppkey"].cast("string"), F.lit(".py\n+++ b/f.py\n@@ -"), x["l_partkey"].cast("string"), F.lit(","),
        x["l_linenumber"].cast("string"), F.lit(" +5 @@ def x():\n-a\n+b\n@@ -5,0 +6,2 @@\n+c\n--- /dev/null\n+++ b/new.py\n@@ -0,1 +1 @@\n+z"),
    )
    return rd.read_diff_export(t.spark, _exported(t, "diff", ["l_suppkey"], line, "commit "))
