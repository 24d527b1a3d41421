"""Readers of exported version-control facts.

Text exports are read as lines or as one text per commit and parsed by column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from changerisk.functions.commits import short_hash, to_utc
from changerisk.operators.dataset import require_columns
from changerisk.schema import FEATURES, FEATURE_TABLE, REPORT_SECTIONS
from changerisk.session import materialize


class MissingValues(ValueError):
    """A feature table has nulls; the message lists the counts by column."""


def read_features(
    spark: SparkSession, path: str, schema: T.StructType | None = None, columns: list[str] | None = None
) -> DataFrame:
    """Feature table from CSV with header. All expected columns must exist and hold no null.

    Further columns are allowed; without a given schema they are read as text.
    """
    expected = columns or FEATURES
    header = spark.read.option("header", True).csv(path)
    require_columns(header, expected)
    types = {f.name: f.dataType for f in (schema or FEATURE_TABLE).fields}
    full = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header.columns])
    df = spark.read.option("header", True).option("mode", "PERMISSIVE").schema(full).csv(path)
    check_no_nulls(df, expected)
    return df


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls and NaNs per column in one pass."""
    types = dict(df.dtypes)

    def missing(c: str):
        if types[c] in ("double", "float"):
            return F.col(c).isNull() | F.isnan(c)
        return F.col(c).isNull()

    return df.agg(*[F.count_if(missing(c)).alias(c) for c in columns])


def check_no_nulls(df: DataFrame, columns: list[str]) -> None:
    found = {c: n for c, n in null_counts(df, columns).first().asDict().items() if n}
    if found:
        raise MissingValues(f"null values in feature columns: {found}")


def parse_change_log(lines: DataFrame, text: str = "value") -> DataFrame:
    """Commits from lines ``sha|author|iso-date|parents``.

    The hash is taken from the left, parents and date from the right, so an author with a bar
    stays whole. Lines with fewer than three fields are skipped.
    """
    row = F.trim(F.col(text))
    parts = F.split(row, r"\|")
    n = F.size(parts)
    dated = lambda i: F.get(parts, i).rlike(r"^\d{4}-\d{2}-\d{2}T")
    date_at = F.when(dated(n - 1), n - 1).when((n > 3) & dated(n - 2), n - 2).otherwise(2)
    return _commit_rows(lines, row, parts, n, date_at, None)


def parse_subject_log(lines: DataFrame, text: str = "value") -> DataFrame:
    """Commits with subjects from lines ``sha|author|iso-date|subject|parents``.

    The date is the first field that looks like one, parents are the last field; what is between
    them is the subject, bars included. Lines with fewer than four fields are skipped.
    """
    row = F.trim(F.col(text))
    parts = F.split(row, r"\|")
    n = F.size(parts)
    tail = F.slice(parts, 3, F.greatest(n - 2, F.lit(0)))
    found = F.array_position(F.transform(tail, lambda p: p.rlike(r"^\d{4}-\d{2}-\d{2}T")), F.lit(True))
    date_at = F.when(found > 0, (found + 1).cast("int")).otherwise(2)
    return _commit_rows(lines, row, parts, n, date_at, "subject")


def _commit_rows(lines, row, parts, n, date_at, subject: str | None) -> DataFrame:
    smallest = 3 if subject is None else 4
    staged = lines.withColumns({"_parts": parts, "_n": n, "_d": date_at}).where(
        (row != "") & (n >= smallest)
    )
    p, count, d = F.col("_parts"), F.col("_n"), F.col("_d")
    if subject is None:
        parents_text = F.when(count - 1 > d, F.get(p, count - 1))
    else:
        parents_text = F.when(count - 1 > d + 1, F.get(p, count - 1))
    parents = F.filter(F.split(F.trim(F.coalesce(parents_text, F.lit(""))), r"\s+"), lambda x: x != "")
    cols = {
        "full_hash": F.get(p, 0),
        "commit_hash": short_hash(F.get(p, 0)),
        "author": F.array_join(F.slice(p, 2, F.greatest(d - 1, F.lit(0))), "|"),
        "commit_timestamp": F.get(p, d),
        "ts": to_utc(F.get(p, d)),
        "parents": parents,
    }
    if subject is not None:
        last = F.when(count - 1 > d + 1, count - 2).otherwise(count - 1)
        cols[subject] = F.array_join(F.slice(p, d + 2, F.greatest(last - d, F.lit(0))), "|")
    extra = [c for c in lines.columns if c not in ("value", "line")]
    return staged.select(*extra, *[c.alias(k) for k, c in cols.items()])


def parse_numstat(lines: DataFrame, text: str = "line") -> DataFrame:
    """Numstat rows ``added<TAB>deleted<TAB>path``; lines with fewer fields are skipped."""
    parts = F.split(F.trim(F.col(text)), "\t")
    extra = [c for c in lines.columns if c != text]
    return (
        lines.withColumn("_p", parts)
        .where(F.size("_p") >= 3)
        .select(
            *extra,
            F.get("_p", F.lit(0)).alias("added"),
            F.get("_p", F.lit(1)).alias("deleted"),
            F.get("_p", F.lit(2)).alias("raw_path"),
        )
    )


# Markers of a zero-context diff.
_FILE_CUT = r"(?md)(?=^--- (?:a/|/dev/null))"
_RANGE = r"@@\s+-(\d+)(?:,(\d+))?\s+\+(\d+)(?:,(\d+))?\s+@@"


def parse_hunk_headers(diffs: DataFrame, text: str = "diff_text") -> DataFrame:
    """Hunks with deleted lines from zero-context diffs, one text per commit.

    A text is cut at its ``---`` lines inside the row, so each hunk knows its file without a
    window. Hunks of new files and hunks that delete nothing are left out.
    """
    extra = [c for c in diffs.columns if c != text]
    parts = diffs.select(*extra, F.explode(F.split(text, _FILE_CUT)).alias("_part"))
    path = F.trim(F.regexp_extract("_part", r"\A--- a/([^\n]*)", 1))
    rows = parts.withColumn("path", path).where(F.col("_part").rlike(r"\A--- a/"))
    heads = rows.select(
        *extra, "path",
        F.explode(F.filter(F.split("_part", "\n"), lambda x: F.startswith(x, F.lit("@@ ")))).alias("_h"),
    )
    return _hunk_rows(heads, extra)


def _hunk_rows(heads: DataFrame, extra: list[str]) -> DataFrame:
    """Hunks that delete lines, from header lines ``_h`` with the ``path`` they belong to."""
    num = lambda g: F.regexp_extract("_h", _RANGE, g).try_cast("bigint")
    one = F.lit(1)
    return heads.where((F.col("path") != "") & _deletes(F.col("_h"))).select(
        *extra, "path", num(1).alias("old_start"), F.coalesce(num(2), one).alias("old_count"),
        num(3).alias("new_start"), F.coalesce(num(4), one).alias("new_count"),
    )


def _deletes(head: Column) -> Column:
    """Whether a line is the header of a hunk that deletes lines."""
    count = F.coalesce(F.regexp_extract(head, _RANGE, 2).try_cast("bigint"), F.lit(1))
    return head.rlike(_RANGE) & (count > 0)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark reports from JSON, a row of four sections (JSON text each) per file.

    A file that is no object, or lacks a section, is an error.
    """
    text = spark.read.text(path, wholetext=True)
    v = F.try_parse_json("value")
    sections = [F.try_variant_get(v, f"$.{s}", "variant").alias(s) for s in REPORT_SECTIONS]
    parsed = text.select(F.schema_of_variant(v).alias("_kind"), *sections)
    row = parsed.agg(
        F.count("*").alias("documents"),
        F.count_if(~F.coalesce(F.startswith("_kind", F.lit("OBJECT")), F.lit(False))).alias("other"),
        *[F.count_if(F.col(s).isNull()).alias(s) for s in REPORT_SECTIONS],
    ).first()
    if not row["documents"] or row["other"]:
        raise ValueError("benchmark report is not a JSON object")
    missing = [s for s in REPORT_SECTIONS if row[s]]
    if missing:
        raise ValueError(f"benchmark report lacks sections: {missing}")
    return parsed.select(*[F.to_json(s).alias(s) for s in REPORT_SECTIONS])


def parse_numstat_export(exports: DataFrame, text: str = "value") -> DataFrame:
    """full_hash, added, deleted, raw_path from numstat exports, one text per row.

    An export lists each commit by a line with its full hash, followed by its numstat lines. A text
    is cut at the hash lines inside the row, so each file row knows its commit without a window.
    """
    extra = [c for c in exports.columns if c != text]
    cut = F.split(text, r"(?m)^(?=(?:commit )?[0-9a-f]{40}\s*$)")
    parts = exports.select(*extra, F.explode(cut).alias("_part"))
    own = F.regexp_extract("_part", r"\A(?:commit )?([0-9a-f]{40})\s*(?:\n|\z)", 1)
    lines = parts.select(*extra, own.alias("full_hash"), F.explode(F.split("_part", "\n")).alias("line"))
    return parse_numstat(lines.where(F.col("full_hash") != ""))


_COMMIT_LINE = r"^(?:commit )?([0-9a-f]{40})\s*$"


def carried_lines(spark: SparkSession, path: str, marks: dict[str, Column], keep: Column) -> DataFrame:
    """Lines of the text files under ``path`` for which ``keep`` holds, each with the last value of every
    mark at or before it in its file.

    ``marks``: name to a text over ``value`` that is null on lines without such a mark. Files are read
    in splits like any text, so one file of any size is worked on by many tasks. Each task carries the
    marks along its splits, in the order it reads them, and stores the kept lines with what they carry.
    What a split begins with comes from a scan over one row per split; only lines before a split's
    first mark meet it.
    """
    names, split = list(marks), ["_file", "_start"]
    keep, found = F.coalesce(keep, F.lit(False)), F.coalesce(keep, F.lit(False))
    for m in marks.values():
        found = found | m.isNotNull()
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    rows = read.where(found).select(F.when(keep, F.col("value")).alias("value"), *split, *[m.alias(n) for n, m in marks.items()])

    def carry(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, last = None, {}
        end = lambda: pd.DataFrame([{"value": None, "_file": own[0], "_start": own[1], **last, "_end": True}])
        for part in parts:
            new = (part["_file"] != part["_file"].shift()) | (part["_start"] != part["_start"].shift())
            for _, run in part.groupby(new.cumsum(), sort=False):
                here = (run["_file"].iat[0], run["_start"].iat[0])
                if here != own:
                    if own is not None:
                        yield end()
                    own, last = here, dict.fromkeys(names)
                filled = run.assign(_end=False)
                for n in names:
                    filled[n] = run[n].ffill() if last[n] is None else run[n].ffill().fillna(last[n])
                    last[n] = filled[n].iat[-1] if pd.notna(filled[n].iat[-1]) else None
                yield filled[filled["value"].notna()]
        if own is not None:
            yield end()

    lines = materialize(rows.mapInPandas(carry, f"value string, _file string, _start long, {', '.join(f'{n} string' for n in names)}, _end boolean"))
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.where("_end").select(*split, *[F.last(n, ignorenulls=True).over(before).alias(f"_b_{n}") for n in names])
    kept, known = lines.where("not _end"), F.lit(True)
    for n in names:
        known = known & F.col(n).isNotNull()
    early = kept.where(~known).join(starts, split).select("value", *[F.coalesce(n, f"_b_{n}").alias(n) for n in names])
    return kept.where(known).select("value", *names).unionByName(early)


def read_numstat_export(spark: SparkSession, path: str) -> DataFrame:
    """full_hash, added, deleted, raw_path from numstat exports of any size.

    An export lists each commit by a line with its full hash, followed by its numstat lines. Lines
    before the first commit of a file are skipped.
    """
    own = F.nullif(F.regexp_extract("value", _COMMIT_LINE, 1), F.lit(""))
    lines = carried_lines(spark, path, {"full_hash": own}, F.contains(F.col("value"), F.lit("\t")))
    return parse_numstat(lines.where("full_hash is not null").select("full_hash", F.col("value").alias("line")))


def read_diff_export(spark: SparkSession, path: str) -> DataFrame:
    """full_hash, path, old_start, old_count, new_start, new_count from zero-context diff exports of any size.

    A line with a commit's full hash goes before its diff. A commit line ends the file before it, as
    does ``--- /dev/null``; hunks without a file, and those that delete nothing, are left out.
    """
    own = F.nullif(F.regexp_extract("value", _COMMIT_LINE, 1), F.lit(""))
    gone = own.isNotNull() | F.startswith(F.col("value"), F.lit("--- /dev/null"))
    named = F.startswith(F.col("value"), F.lit("--- a/"))
    file = F.when(gone, F.lit("")).when(named, F.trim(F.substring("value", 7, 1 << 30)))
    rows = carried_lines(spark, path, {"full_hash": own, "path": file}, F.startswith(F.col("value"), F.lit("@@ ")) & _deletes(F.col("value")))
    return _hunk_rows(rows.where("full_hash is not null").withColumnRenamed("value", "_h"), ["full_hash"])


def read_commit_facts(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Exported facts: ``change_log``, ``subject_log``, ``numstat`` or ``diff``.

    The latter two are read as :func:`read_numstat_export` and :func:`read_diff_export` have them.
    """
    if kind == "numstat":
        return read_numstat_export(spark, path)
    if kind == "diff":
        return read_diff_export(spark, path)
    lines = spark.read.text(path)
    if kind == "change_log":
        return parse_change_log(lines)
    if kind == "subject_log":
        return parse_subject_log(lines)
    raise ValueError(f"unknown kind of export: {kind}")
