"""Review context of a commit: which diff text fits a byte budget, and the text itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from changerisk.functions.paths import file_priority
from changerisk.operators.ordered import running_totals
from changerisk.session import materialize

KEY = ["repo", "full_hash"]
# A usual byte budget (callers name theirs) and the smallest rest worth filling.
MAX_BYTES = 50_000
SMALLEST_CUT = 20
CUT_NOTE = "\n[TRUNCATED: File diff cut off due to context size limit]"


def file_text(files: DataFrame) -> DataFrame:
    """Add the text of each file as it enters a context; generated and binary files are one line."""
    hunk = lambda h: F.array_join(
        F.concat(
            F.array(h["header"]),
            F.transform(h["lines"], lambda x: F.concat(x["line_type"], x["content"])),
        ),
        "\n",
    )
    body = F.array_join(F.transform("hunks", hunk), "\n")
    head = F.concat(F.lit("--- "), "old_path", F.lit("\n+++ "), "new_path", F.lit("\n"))
    text = (
        F.when(F.col("is_binary"), F.concat(head, F.lit("Binary files differ\n")))
        .when(
            F.col("is_generated"),
            F.concat(head, F.lit("[Generated file omitted from diff: "), "new_path", F.lit("]\n")),
        )
        .otherwise(F.concat(head, body, F.when(F.size("hunks") > 0, "\n").otherwise("")))
    )
    return files.withColumn("text", text).withColumns(
        {
            "priority": file_priority(F.col("is_binary"), F.col("is_generated")),
            "bytes": F.octet_length("text").cast("bigint"),
        }
    )


def cut_utf8(text: Column, size: Column) -> Column:
    """First ``size`` bytes of a text without a broken last character."""
    raw = F.encode(text, "UTF-8")

    def prefix(back: int) -> Column:
        return F.substring(raw, F.lit(1), F.greatest(size - back, F.lit(0)).cast("int")).cast("string")

    out = None
    for back in range(4):
        p = prefix(back)
        out = F.when(F.is_valid_utf8(p), p) if out is None else out.when(F.is_valid_utf8(p), p)
    return out


def pack_context(files: DataFrame, budget: int) -> DataFrame:
    """Decide for each file whether it is included, cut or dropped.

    Files go by (priority, order in the diff) while their bytes fit; the first that does not is
    cut to what is left if that is more than 20 bytes, and all after it are dropped. Only sizes
    are summed; texts stay where they are.
    """
    sizes = materialize(files.select(*KEY, "file_ord", "priority", "bytes"))
    summed = running_totals(sizes, KEY, ["priority", "file_ord"], {"upto": "bytes"})
    before = F.col("upto") - F.col("bytes")
    room = F.lit(budget) - before
    cut = (F.col("upto") > budget) & (before <= budget) & (room > SMALLEST_CUT)
    return summed.withColumn(
        "state", F.when(F.col("upto") <= budget, "included").when(cut, "cut").otherwise("dropped")
    ).select(
        *KEY,
        "file_ord",
        "priority",
        "bytes",
        "state",
        F.when(F.col("state") == "included", F.col("bytes"))
        .when(F.col("state") == "cut", room)
        .otherwise(0)
        .cast("bigint")
        .alias("kept_bytes"),
    )


def packing_summary(packed: DataFrame) -> DataFrame:
    """Original and included bytes and the number of files not fully included, per commit."""
    return packed.groupBy(*KEY).agg(
        F.sum("bytes").alias("original_bytes"),
        F.sum("kept_bytes").alias("included_bytes"),
        F.count_if(F.col("state") != "included").alias("truncated_files"),
    ).withColumn("is_truncated", F.col("truncated_files") > 0)


def inventory_line() -> Column:
    notes = F.concat(
        F.when(F.col("is_generated"), " [GENERATED]").otherwise(""),
        F.when(F.col("is_binary"), " [BINARY]").otherwise(""),
    )
    return F.concat(
        F.lit("- "), "new_path", F.lit(" ("), "status", F.lit("): +"), F.col("additions").cast("string"),
        F.lit(" -"), F.col("deletions").cast("string"), notes,
    )


def build_review_context(
    commits: DataFrame, files: DataFrame, budget: int, scores: DataFrame | None = None
) -> DataFrame:
    """Text per commit: metadata, score, complete file list and the packed diff.

    ``files`` has text, priority and bytes (:func:`file_text`); what is put together for a commit
    was cut from its one diff text, and the diff part is at most ``budget`` bytes. Texts are stored
    once, as the sizes are packed first.
    """
    line = inventory_line().alias("line")
    files = materialize(files.select(*KEY, "file_ord", "priority", "bytes", "additions", "deletions", line, "text"))
    packed = pack_context(files, budget)
    shown = files.join(packed.select(*KEY, "file_ord", "state", "kept_bytes"), [*KEY, "file_ord"])
    part = F.when(F.col("state") == "included", F.col("text")).when(
        F.col("state") == "cut", F.concat(cut_utf8(F.col("text"), F.col("kept_bytes")), F.lit(CUT_NOTE))
    )
    rows = shown.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("file_ord", "line"))).alias("_inv"),
        F.array_sort(
            F.collect_list(
                F.when(part.isNotNull(), F.struct("priority", "file_ord", part.alias("part")))
            )
        ).alias("_parts"),
        F.count("*").alias("_files"),
        F.sum("additions").alias("_plus"),
        F.sum("deletions").alias("_minus"),
    )
    out = commits.join(rows, KEY, "left").join(packing_summary(packed), KEY, "left")
    if scores is None:
        score = F.lit("Risk score: not provided")
    else:
        out = out.join(scores, KEY, "left")
        score = F.when(
            F.col("raw_probability").isNotNull(),
            F.format_string(
                "Risk score: %.4f (threshold %.2f), %s",
                F.col("raw_probability"), F.col("decision_threshold"), F.col("risk_level"),
            ),
        ).otherwise("Risk score: not provided")
    inventory = F.when(F.size("_inv") > 0, F.array_join(F.transform("_inv", lambda x: x["line"]), "\n"))
    diff = F.array_join(F.transform("_parts", lambda x: x["part"]), "\n")
    # The wording of the note, the statistics and the headings.
    note = F.when(
        F.col("is_truncated"),
        F.format_string(
            f"\n\n[TRUNCATED: Total diff exceeded context budget of {budget} bytes. "
            "%d files/hunks omitted or truncated.]",
            F.col("truncated_files"),
        ),
    ).otherwise("")
    zero = F.lit(0)
    stats = F.format_string(
        "Stats: %d files changed, %d additions (+), %d deletions (-)",
        F.coalesce("_files", zero.cast("bigint")), F.coalesce("_plus", zero.cast("bigint")),
        F.coalesce("_minus", zero.cast("bigint")),
    )
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Commit: "), "full_hash"),
        F.concat(F.lit("Author: "), "author"),
        F.concat(F.lit("Date: "), "commit_timestamp"),
        F.concat(F.lit("Message: "), "subject"),
        stats,
        score,
        F.lit("## Changed files"),
        F.coalesce(inventory, F.lit("No files changed.")),
        F.lit("## Diff"),
        F.concat(F.coalesce(diff, F.lit("")), F.coalesce(note, F.lit(""))),
    )
    return out.select(
        *KEY,
        text.alias("context"),
        F.coalesce("original_bytes", F.lit(0)).alias("original_bytes"),
        F.coalesce("included_bytes", F.lit(0)).alias("included_bytes"),
        F.coalesce("truncated_files", F.lit(0)).alias("truncated_files"),
        F.coalesce("is_truncated", F.lit(False)).alias("is_truncated"),
    )
