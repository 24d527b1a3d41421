"""What the operators of this subpackage share: reading, storing, splits, hashed samples."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from changerisk.session import work_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def set_aside(docs: DataFrame, used: tuple[str, ...] = ("doc_id", "text", "lang", "source")) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all other columns renamed, so that none clashes with a working column; and the way back."""
    names = [c if c in used else f"_extra_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda df: df.select(*names).toDF(*docs.columns)


_shipped: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Texts that are handed to a task's Python at once.
BATCH_ROWS = 1_000


def ship_code(spark: SparkSession) -> None:
    """Make ``spark`` ready for these operators.

    Sends this package to the executors, once per application: they need not have it installed. Rows
    are whole texts, so unless the session says otherwise fewer of them go to a task's Python at once.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[2]
        staging = tempfile.mkdtemp(prefix="spark-")  # Spark reads the archive as long as it runs
        atexit.register(shutil.rmtree, staging, ignore_errors=True)
        shutil.copytree(root / "changerisk", Path(staging, "code", "changerisk"), ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(f"{staging}/changerisk", "zip", f"{staging}/code"))
        _shipped.add(sc.applicationId)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back.

    Cuts lineage in files that outlive an executor, and gives Spark the true size of the table,
    from which it decides on broadcasts.
    """
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}[kind.simpleString()]


def map_exactly(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: T.StructType, reads: list[str]) -> DataFrame:
    """``df.mapInPandas`` in which what ``fn`` does not make passes by as it is in Arrow.

    ``fn`` gets the columns it ``reads`` and ``_at``, each row's number in its batch. It returns ``_at`` and
    the columns it makes, of one batch before it takes the next; all others of ``schema`` are taken from
    the input. So neither ids beyond 2**53 next to nulls nor columns of other types change.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: list[pa.RecordBatch] = []

        def frames() -> Iterator[pd.DataFrame]:
            for batch in batches:
                current[:] = [batch]
                yield batch.select(reads).to_pandas().assign(_at=np.arange(batch.num_rows))

        for part in fn(frames()):
            at = pa.array(part["_at"].to_numpy())
            made = lambda f: pa.array(part[f.name].tolist(), _arrow(f.dataType))
            columns = [made(f) if f.name in part.columns else current[0][f.name].take(at) for f in schema.fields]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return df.mapInArrow(run, schema)


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """``crc32`` of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def hash_fraction(*parts: Column) -> Column:
    """A reproducible number in [0, 1) per row, independent of how rows are dealt out."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long") / float(1 << 48)


def hashed_sample(df: DataFrame, groups: list[str], bound: int, *identity: Column) -> DataFrame:
    """About ``bound`` rows of each group, picked by hash: all of a group that is no larger.

    Group sizes are counted first, then each row compares its hash with its group's rate; no
    group is sorted or gathered. The size is binomial around ``bound``.
    """
    drawn = hash_fraction(*identity)
    if not groups:
        return df.where(drawn * F.lit(float(df.count())) < F.lit(float(bound)))
    # Other names than the rows' own, so that extra columns cannot clash. Stored, so that Spark knows
    # how small the table is before it plans to move rows for it.
    renamed = {g: f"_group_{i}" for i, g in enumerate(groups)}
    sizes = stored(df.groupBy(*[F.col(g).alias(n) for g, n in renamed.items()]).agg(F.count("*").alias("_rows")))
    match = F.lit(True)
    for g, n in renamed.items():
        match = match & df[g].eqNullSafe(F.col(n))
    return df.join(sizes, match).where(drawn * F.col("_rows") < F.lit(float(bound))).select(*[df[c] for c in df.columns])
