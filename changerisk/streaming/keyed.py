"""A table of one live row per key that a stream keeps up to date in plain Parquet.

Each micro-batch writes a delta; every so many batches the deltas are folded into a snapshot, dealt
by the key's hash into buckets, and a pointer to it is written last. Readers take the snapshot that
the pointer names and the deltas after it, so what they read and list depends on the keys and on the
batches since then, not on the age of the stream. A batch owns its delta and a snapshot its folder:
running either again writes the same rows. Superseded folders may be removed at any time by whoever
manages the storage, once no reader of an older pointer is left.

Layout: ``pointers`` (upto), ``snapshots/upto=N``, ``deltas/after=N/batch_id=M``, the latter two with
``bucket=B`` below.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.query import StreamingQuery

#: Work through what is there and stop.
ALL_THERE_IS = {"availableNow": True}


@dataclass
class KeyedTable:
    """``keys`` and ``order`` are columns of ``schema``; of a key's rows the largest by ``order`` lives,
    rows of equal order by their batch and then by their values."""

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: list[str]
    order: list[str]
    buckets: int = 16
    compact_every: int = 10

    @property
    def _stored(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("first_batch", T.LongType()), T.StructField("last_batch", T.LongType())])

    @property
    def _listed(self) -> T.StructType:
        return T.StructType([*self._stored.fields, T.StructField("bucket", T.IntegerType())])

    def create(self) -> None:
        """An empty table; one that is there stays as it is."""
        self._empty().write.mode("ignore").partitionBy("bucket").parquet(f"{self.path}/snapshots/upto=-1")
        self._empty().write.mode("ignore").partitionBy("bucket").parquet(f"{self.path}/deltas/after=-1/batch_id=-1")
        self.spark.createDataFrame([(-1,)], "upto long").coalesce(1).write.mode("ignore").parquet(f"{self.path}/pointers")

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self._listed)

    def upto(self) -> int:
        """The last batch that is in the snapshot."""
        return self.spark.read.schema("upto long").parquet(f"{self.path}/pointers").agg(F.max("upto")).first()[0]

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _files(self, upto: int) -> DataFrame:
        """Rows of the snapshot and of the deltas after it."""
        snapshot = self.spark.read.schema(self._listed).parquet(f"{self.path}/snapshots/upto={upto}")
        deltas = self.spark.read.schema(T.StructType([*self._listed.fields, T.StructField("batch_id", T.LongType())])).parquet(f"{self.path}/deltas/after={upto}")
        return snapshot.unionByName(deltas.drop("batch_id"))

    def _live(self, rows: DataFrame) -> DataFrame:
        payload = [f.name for f in self.schema.fields if f.name not in self.keys]
        kept = F.struct(*payload, "last_batch")
        newest = F.max_by(kept, F.struct(*self.order, "last_batch", kept))
        one = rows.groupBy(*self.keys).agg(newest.alias("_r"), F.min("first_batch").alias("first_batch"))
        return one.select(*self.keys, "_r.*", "first_batch").select(*self._stored.names)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The live rows, with the first and the last batch that wrote each key; of some ``buckets`` only, if named."""
        rows = self._files(self.upto())
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        return self._live(rows.drop("bucket"))

    def upsert(self, rows: DataFrame, batch_id: int) -> None:
        """Apply the rows of a batch. A batch that the snapshot holds already is left alone."""
        upto = self.upto()
        if batch_id <= upto:
            return
        batch = F.lit(batch_id).cast("long")
        own = self._live(rows.select(*self.schema.names, batch.alias("first_batch"), batch.alias("last_batch")))
        own.withColumn("bucket", self.bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/deltas/after={upto}/batch_id={batch_id}")
        if batch_id - upto >= self.compact_every:
            self.compact(batch_id)

    def compact(self, batch_id: int) -> None:
        """Fold all batches up to ``batch_id`` into a new snapshot, and point to it last."""
        live = self._live(self._files(self.upto()).drop("bucket")).withColumn("bucket", self.bucket())
        live.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/snapshots/upto={batch_id}")
        self._empty().write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/deltas/after={batch_id}/batch_id=-1")
        self.spark.createDataFrame([(batch_id,)], "upto long").coalesce(1).write.mode("append").parquet(f"{self.path}/pointers")


def delivery_ledger(spark: SparkSession, path: str, **how) -> KeyedTable:
    """Ledger of the delivery ids that have been seen."""
    return KeyedTable(spark, path, T.StructType.fromDDL("delivery_id string, received_at timestamp"), ["delivery_id"], ["received_at"], **how)


def first_deliveries(batch: DataFrame, batch_id: int, ledger: KeyedTable, out: str) -> None:
    """Write the rows of ``batch`` whose delivery id no earlier batch had, and enter their ids.

    Of one id in the batch the earliest row stays. Only the buckets of the ledger that the batch's
    ids fall into are read. The rows go to the batch's own folder under ``out``, and ids that the
    ledger has of this batch do not count as seen, so a batch that runs twice leaves one copy. Rows
    without an id have nothing to be told apart by: all stay.
    """
    unnamed = batch.where(F.col("delivery_id").isNull())
    named = batch.where(F.col("delivery_id").isNotNull())
    row = F.struct(*batch.columns)
    once = named.groupBy("delivery_id").agg(F.min_by(row, F.struct("received_at", F.xxhash64(F.to_json(row)))).alias("_r")).select("_r.*")
    once = once.withColumn("_bucket", ledger.bucket())
    touched = [r[0] for r in once.select("_bucket").distinct().collect()]  # as many as buckets at most
    seen = ledger.read(touched).where(F.col("first_batch") < batch_id).select("delivery_id")
    fresh = once.drop("_bucket").join(seen, "delivery_id", "left_anti").select(*batch.columns)
    fresh.unionByName(unnamed).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    entered = batch.sparkSession.read.schema(batch.schema).parquet(f"{out}/batch_id={batch_id}").where(F.col("delivery_id").isNotNull())
    ledger.upsert(entered, batch_id)


def redelivery_stream(events: DataFrame, ledger: KeyedTable, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """First deliveries of ``events`` (delivery_id, received_at, ...) under ``out``, however late a redelivery comes.

    The stream engine keeps no state: what has been seen is in ``ledger``.
    """
    ledger.create()
    return (
        events.writeStream.foreachBatch(lambda b, i: first_deliveries(b, i, ledger, out))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ALL_THERE_IS))
        .start()
    )


def live_reports(spark: SparkSession, path: str, **how) -> KeyedTable:
    """Table of the live report of each pull request."""
    schema = T.StructType.fromDDL("owner string, repository string, number bigint, report string, received_at timestamp, delivery_id string")
    return KeyedTable(spark, path, schema, ["owner", "repository", "number"], ["received_at", "delivery_id"], **how)


def live_report_stream(events: DataFrame, render, table: KeyedTable, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep the live reports up to date; ``render`` turns a batch of accepted events into rows with a ``report``."""
    table.create()
    return (
        events.writeStream.foreachBatch(lambda b, i: table.upsert(render(b), i))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ALL_THERE_IS))
        .start()
    )
