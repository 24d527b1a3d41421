"""Unified diff texts as tables of files, hunks and lines.

One row holds the diff text of one commit. Files, hunks and numbered lines are cut inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from changerisk.functions.paths import is_generated_file
from changerisk.functions.text import lines_of, strip
from changerisk.session import worked_out

KEY = ["repo", "full_hash"]
# Diff markers.
GIT_HEADER = r"^diff --git a/(.*?) b/(.*)"
HUNK_HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)"
HEADER_LINES = 9  # of which the original text rules read file marks
PIECE = 256  # lines of a hunk that are numbered together
_AT_LINE_START = r"(?<![^\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}])"
# The marker is looked for first: what stands before it is asked only where there is one.
_HUNK_CUT = r"(?=@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@)" + _AT_LINE_START


def split_diff_files(diffs: DataFrame) -> DataFrame:
    """One row per file of a diff: repo, full_hash, file_ord, block and the two header paths."""
    parts = F.filter(
        F.split("diff_text", r"(?md)(?=^diff --git )"), lambda b: F.startswith(b, F.lit("diff --git "))
    )
    cut = diffs.select(*KEY, F.posexplode_outer(parts).alias("file_ord", "block")).where(
        F.col("file_ord").isNotNull()
    )
    head = _first_line(F.col("block"))
    return cut.withColumns(
        {
            "old_path": F.regexp_extract(head, GIT_HEADER, 1),
            "new_path": F.regexp_extract(head, GIT_HEADER, 2),
        }
    )


def _first_line(text: Column) -> Column:
    return F.get(lines_of(F.substring_index(text, "\n", 1)), 0)


def hunks_of(pieces: Column, compat: bool = False) -> Column:
    """Array of hunks of a file block cut at its hunk headers, each with its typed lines.

    A line that starts with ``+++`` or ``---`` inside a hunk is an added or deleted line;
    ``compat=True`` skips it.
    """
    headed = F.filter(pieces, lambda h: h.rlike(HUNK_HEADER))

    def one(h: Column) -> Column:
        head = _first_line(h)
        num = lambda g: F.regexp_extract(head, HUNK_HEADER, g).try_cast("bigint")
        body = F.filter(F.slice(lines_of(h), 2, 2**30), _is_line)
        return F.struct(
            num(1).alias("old_start"),
            F.coalesce(num(2), F.lit(1)).alias("old_lines"),
            num(3).alias("new_start"),
            F.coalesce(num(4), F.lit(1)).alias("new_lines"),
            strip(F.regexp_extract(head, HUNK_HEADER, 5)).alias("header"),
            F.transform(body, _typed).alias("lines"),
        )

    def _is_line(x: Column) -> Column:
        kept = F.substring(x, 1, 1).isin("+", "-", " ", "")
        return kept & ~F.substring(x, 1, 3).isin("+++", "---") if compat else kept

    def _typed(x: Column) -> Column:
        return F.struct(
            F.when(x == "", " ").otherwise(F.substring(x, 1, 1)).alias("line_type"),
            F.substring(x, 2, 2**31 - 1).alias("content"),
        )

    return F.filter(
        F.transform(headed, one), lambda h: (h["old_start"] > 0) | (h["new_start"] > 0)
    )


def classify_files(files: DataFrame, compat: bool = False) -> DataFrame:
    """Status, rename paths, binary and generated flags, and the hunks of each file.

    Marks are read from all lines before the first hunk; ``compat=True`` reads HEADER_LINES lines.
    A file is generated if its old or its new path is that of a generated file.
    """
    files = worked_out(files, _pieces=F.split("block", _HUNK_CUT))
    if compat:
        head = F.slice(lines_of(F.substring_index("block", "\n", HEADER_LINES + 1)), 2, HEADER_LINES)
    else:
        head = F.slice(lines_of(F.get("_pieces", F.lit(0))), 2, 2**30)
    marks = [
        ("new file mode", "ADDED"),
        ("deleted file mode", "DELETED"),
        ("rename from", "RENAMED"),
        ("rename to", "RENAMED"),
        ("copy from", "COPIED"),
        ("copy to", "COPIED"),
    ]

    def status_of(line: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for prefix, status in marks:
            out = out.when(F.startswith(line, F.lit(prefix)), status)
        return out

    def moved(kind: str, fallback: str) -> Column:
        pattern = rf"\A(?:rename|copy) {kind} ?(.*)"
        hits = F.filter("_head", lambda x: x.rlike(rf"\A(?:rename|copy) {kind}"))
        last = F.try_element_at(hits, F.lit(-1))
        return F.coalesce(strip(F.regexp_extract(last, pattern, 1)), F.col(fallback))

    binary = F.exists(
        "_head",
        lambda x: status_of(x).isNull()
        & (F.contains(x, F.lit("Binary files")) | F.startswith(x, F.lit("GIT binary patch"))),
    )
    states = F.filter(F.transform("_head", status_of), lambda s: s.isNotNull())
    named = files.withColumn("_head", head).withColumns(
        {
            "status": F.coalesce(F.try_element_at(states, F.lit(-1)), F.lit("MODIFIED")),
            "old_path": moved("from", "old_path"),
            "new_path": moved("to", "new_path"),
            "is_binary": binary,
        }
    )
    generated = is_generated_file(F.col("old_path")) | is_generated_file(F.col("new_path"))
    none = F.array().cast("array<string>")
    pieces = F.when(F.col("is_binary"), none).otherwise(F.col("_pieces"))
    return named.withColumns(
        {"is_generated": generated, "hunks": hunks_of(pieces, compat)}
    ).drop("_head", "_pieces", "block")


def count_lines(kind: str) -> Column:
    """Number of lines of one type over all hunks of a file."""
    return F.aggregate(
        "hunks",
        F.lit(0).cast("bigint"),
        lambda n, h: n + F.size(F.filter(h["lines"], lambda x: x["line_type"] == kind)),
    )


def match_numstat(files: DataFrame, numstat: DataFrame | None = None) -> DataFrame:
    """Add additions and deletions: from the first matching numstat row, else counted.

    ``numstat``: repo, full_hash, num_ord, raw_path, path, added, deleted, is_binary. Either path
    of the row may equal either path of the file; both sides list their distinct paths and are
    joined on equality.
    """
    counted = files.withColumns({"_plus": count_lines("+"), "_minus": count_lines("-")})
    if numstat is None:
        return counted.withColumnsRenamed({"_plus": "additions", "_minus": "deletions"})
    left = files.select(
        *KEY, "file_ord", F.explode(F.array_distinct(F.array("new_path", "old_path"))).alias("_p")
    )
    right = numstat.select(
        *KEY, "num_ord", "added", "deleted", F.col("is_binary").alias("_nb"),
        F.explode(F.array_distinct(F.array("path", "raw_path"))).alias("_p"),
    )
    first = (
        left.join(right, [*KEY, "_p"])
        .groupBy(*KEY, "file_ord")
        .agg(F.min_by(F.struct("added", "deleted", "_nb"), "num_ord").alias("_n"))
    )
    joined = counted.join(first, [*KEY, "file_ord"], "left")
    is_binary = F.col("is_binary") | F.coalesce(F.col("_n._nb"), F.lit(False))
    none = F.filter("hunks", lambda h: F.lit(False))
    return joined.select(
        *[c for c in files.columns if c not in ("is_binary", "hunks")],
        is_binary.alias("is_binary"),
        F.when(is_binary, none).otherwise(F.col("hunks")).alias("hunks"),
        F.coalesce(F.col("_n.added"), F.col("_plus")).alias("additions"),
        F.coalesce(F.col("_n.deleted"), F.col("_minus")).alias("deletions"),
    )


def diff_hunks(files: DataFrame) -> DataFrame:
    """One row per hunk."""
    rows = files.select(*KEY, "file_ord", F.posexplode_outer("hunks").alias("hunk_ord", "h"))
    return rows.where(F.col("hunk_ord").isNotNull()).select(*KEY, "file_ord", "hunk_ord", "h.*")


def explode_diff_lines(files: DataFrame) -> DataFrame:
    """One row per diff line with its old and new line number.

    The numbers come out of the hunk's own array, so no line is moved: it is cut into pieces of
    PIECE lines, counts of the pieces are summed up, and a line counts only inside its piece.
    """
    hunks = diff_hunks(files).where(F.size("lines") > 0)
    number = F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / PIECE).cast("int"))
    pieces = F.transform(number, lambda i: F.slice("lines", i * PIECE + 1, F.lit(PIECE)))
    cut = hunks.select(
        *KEY, "file_ord", "hunk_ord", "old_start", "new_start", "lines",
        F.transform(pieces, lambda x: F.array_join(F.transform(x, lambda l: l["line_type"]), "")).alias("_kinds"),
    )
    placed = cut.select(
        *KEY, "file_ord", "hunk_ord",
        F.posexplode(
            F.arrays_zip(
                pieces.alias("lines"), F.col("_kinds").alias("kinds"),
                _starts("_kinds", "+", "old_start").alias("old"), _starts("_kinds", "-", "new_start").alias("new"),
            )
        ).alias("_piece", "p"),
    )
    rows = placed.select(
        *KEY, "file_ord", "hunk_ord", "_piece", "p.kinds", "p.old", "p.new", F.posexplode("p.lines").alias("_at", "l")
    )
    upto = F.substring("kinds", F.lit(1), F.col("_at") + 1)
    kind = F.col("l.line_type")
    return rows.select(
        *KEY, "file_ord", "hunk_ord", (F.col("_piece") * PIECE + F.col("_at")).alias("line_ord"), kind.alias("line_type"),
        F.when(kind != "+", F.col("old") + _counted(upto, "+") - 1).alias("old_lineno"),
        F.when(kind != "-", F.col("new") + _counted(upto, "-") - 1).alias("new_lineno"),
        F.col("l.content").alias("content"),
    )


def _counted(kinds: Column, other: str) -> Column:
    """How many lines are not of the kind that the other side alone has."""
    return F.length(F.translate(kinds, other, "")).cast("bigint")


def _starts(kinds: str, other: str, start: str) -> Column:
    """The number that the first line of each piece of one side would have."""
    firsts = F.aggregate(
        kinds,
        F.array(F.col(start)),
        lambda sums, k: F.array_append(sums, F.element_at(sums, -1) + _counted(k, other)),
    )
    return F.slice(firsts, 1, F.size(kinds))


def diff_totals(commits: DataFrame, files: DataFrame, *more: Column) -> DataFrame:
    """Additions, deletions and file count per commit, and ``more`` aggregates of its files.

    A commit without files is empty.
    """
    sums = files.groupBy(*KEY).agg(
        F.count("*").alias("files"),
        F.sum("additions").alias("total_additions"),
        F.sum("deletions").alias("total_deletions"),
        *more,
    )
    zero = F.lit(0).cast("bigint")
    return commits.select(*KEY).join(sums, KEY, "left").select(
        *KEY,
        *[F.coalesce(c, zero).alias(c) for c in ("files", "total_additions", "total_deletions")],
        F.col("files").isNull().alias("is_empty_commit"),
        *sums.columns[len(KEY) + 3 :],
    )


def assemble_commit_diff(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Nested document per commit (files, hunks, lines) and its JSON.

    Everything put together again for a commit was cut from its one diff text. Files meet their
    commit once, for the totals and the list.
    """
    entry = F.struct(
        "file_ord", "old_path", "new_path", "status", "is_binary", "is_generated", "additions",
        "deletions", "hunks",
    )
    listed = F.array_sort(F.collect_list(entry)).alias("files_changed")
    out = diff_totals(commits, files, listed)
    return out.withColumn("json", F.to_json(F.struct(*[c for c in out.columns])))
