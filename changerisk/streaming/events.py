"""Pull-request events as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.query import StreamingQuery

from changerisk.operators import events as ev
from changerisk.schema import EVENT_SOURCE

PR_KEY = ["owner", "repository", "number"]
REPORT_LOG = (
    "owner string, repository string, number bigint, report string, received_at timestamp, batch_id int"
)


def read_event_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of raw events from a folder of parquet files with a fixed schema."""
    reader = spark.readStream.schema(EVENT_SOURCE).format("parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


#: Work through what is there and stop; pass ``{"processingTime": "10 seconds"}`` to keep running.
ALL_THERE_IS = {"availableNow": True}


def ingest_pr_events(
    events: DataFrame,
    accepted_path: str,
    rejected_path: str,
    checkpoint: str,
    secret: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Classify events and write accepted and rejected rows to two tables.

    Each micro-batch owns the partition ``batch_id`` of both tables and overwrites it, so a batch
    that runs twice leaves one copy. ``events`` may come from any source; ``trigger`` holds the
    arguments of the writer's trigger.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            ev.accepted(batch).write.mode("overwrite").parquet(f"{accepted_path}/batch_id={batch_id}")
            ev.rejected(batch).drop("headers", "body").write.mode("overwrite").parquet(
                f"{rejected_path}/batch_id={batch_id}"
            )
        finally:
            batch.unpersist()

    return (
        ev.classify_events(events, secret)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ALL_THERE_IS))
        .start()
    )


def drop_redeliveries(events: DataFrame, delay: str | None = None, time_column: str = "received_at") -> DataFrame:
    """Keep the first event of each delivery id, whenever it comes.

    The ids seen are state that grows with the stream. ``delay`` bounds it by a watermark, at a
    price: an event that is later than that is dropped even if it is the only one of its id.
    """
    if delay is None:
        return events.dropDuplicates(["delivery_id"])
    return events.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(["delivery_id"])


def latest_reports(log: DataFrame) -> DataFrame:
    """The live report of each pull request in an upsert log: the one of its newest event.

    ``action`` is ``updated`` if an earlier batch wrote the pull request already.
    """
    newest = F.max_by(F.struct("report", "batch_id"), F.struct("received_at", "batch_id"))
    live = log.groupBy(*PR_KEY).agg(newest.alias("_r"), F.min("batch_id").alias("_first"))
    action = F.when(F.col("_first") < F.col("_r.batch_id"), "updated").otherwise("created")
    return live.select(*PR_KEY, F.col("_r.report").alias("report"), action.alias("action"), F.col("_r.batch_id").alias("batch_id"))


def upsert_reports(batch: DataFrame, batch_id: int, log_path: str) -> None:
    """Append one batch to the report log: one row per pull request.

    Nothing that earlier batches wrote is read: what is new and what is an update is told when the
    log is read. The batch owns its partition, so running it again writes the same rows.
    """
    newest = F.max_by(F.struct("report", "received_at"), F.struct("received_at", "delivery_id"))
    latest = batch.groupBy(*PR_KEY).agg(newest.alias("_r")).select(*PR_KEY, "_r.*")
    latest.write.mode("overwrite").parquet(f"{log_path}/batch_id={batch_id}")


def report_stream(events: DataFrame, render, log_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep the report log up to date from a stream of accepted events.

    ``render`` turns a batch of events into rows with a ``report`` column.
    """
    return (
        events.writeStream.foreachBatch(lambda b, i: upsert_reports(render(b), i, log_path))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ALL_THERE_IS))
        .start()
    )


#: Digits of a commit hash by which stored features are dealt into folders.
PREFIX = 2


def store_by_prefix(features: DataFrame, path: str, digits: int = PREFIX) -> None:
    """Store a feature table (repo, full_hash, ...) in one folder per prefix of the hash."""
    dealt = features.withColumn("prefix", F.substring("full_hash", 1, digits))
    dealt.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(path)


def features_of(heads: DataFrame, path: str, digits: int = PREFIX) -> DataFrame:
    """Stored features that commits of ``heads`` (head_sha) may have: only the folders of their prefixes are read."""
    prefix = F.substring("head_sha", 1, digits)
    wanted = [r[0] for r in heads.where(F.col("head_sha").isNotNull()).select(prefix).distinct().collect()]  # 16 ** digits at most
    spark = heads.sparkSession
    # Prefixes stay text: 00 and 0e1 are no numbers.
    schema = spark.read.parquet(path).schema
    fields = [f if f.name != "prefix" else T.StructField("prefix", T.StringType()) for f in schema.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path).where(F.col("prefix").isin(wanted)).drop("prefix")


def score_batches(events: DataFrame, path: str, scorer, out: str, checkpoint: str, columns: list[str], digits: int = PREFIX, trigger: dict | None = None) -> StreamingQuery:
    """Score accepted events with features stored by :func:`store_by_prefix`, batch by batch.

    A batch reads the folders that its commits fall into, not the whole table, and owns its folder
    under ``out``. Events without features keep a row; ``columns`` are written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            scored = score_stream(batch, features_of(batch, path, digits), scorer)
            scored.select(*columns).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or ALL_THERE_IS)).start()


def score_stream(events: DataFrame, features: DataFrame, scorer) -> DataFrame:
    """Join accepted events with the static feature table on the head commit and score them.

    ``features`` has repo as ``owner/repository`` and full_hash; ``scorer`` is a function from a
    feature frame to a scored frame.
    """
    named = events.withColumns(
        {"repo": F.concat_ws("/", "owner", "repository"), "full_hash": F.col("head_sha")}
    )
    joined = named.join(features, ["repo", "full_hash"], "left")
    return scorer(joined)
