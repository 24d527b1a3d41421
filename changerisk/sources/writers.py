"""Sinks for tables, reports and model artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from changerisk.schema import DATASET_COLUMNS, REPORT_SECTIONS


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, mode: str = "overwrite"
) -> None:
    """Store a table; datasets and splits are partitioned (repository, split) for pruning."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_dataset(dataset: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The training table: identifiers, features and target, nothing else."""
    keep = [c for c in ("repo", "split") if c in dataset.columns]
    write_table(dataset.select(*keep, *DATASET_COLUMNS), path, fmt, keep or None)


def report_document(metadata: DataFrame, anchor: DataFrame, candidates: DataFrame, summary: DataFrame) -> DataFrame:
    """One JSON document with the four report sections; each input is a small result table."""

    def section(df: DataFrame, name: str) -> DataFrame:
        rows = F.collect_list(F.struct(*df.columns))
        return df.agg(F.to_json(F.sort_array(rows)).alias(name))

    parts = [section(d, n) for d, n in zip((metadata, anchor, candidates, summary), REPORT_SECTIONS, strict=True)]
    out = parts[0].withColumn("_k", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("_k", F.lit(1)), "_k")
    body = F.concat_ws(
        ",", *[F.concat(F.lit(f'"{n}":'), F.col(n)) for n in REPORT_SECTIONS]
    )
    return out.select(F.concat(F.lit("{"), body, F.lit("}")).alias("value"))


def write_text(df: DataFrame, path: str, column: str = "value") -> None:
    """Rendered texts (JSON or Markdown), one row per line of output."""
    df.select(column).write.mode("overwrite").text(path)
