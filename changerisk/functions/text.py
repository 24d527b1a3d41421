"""Expressions over free text, references and display strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from changerisk.functions.rounding import round_exact
from changerisk.schema import PRODUCTION_THRESHOLD

# Every break that ends a line of text (CRLF counts once).
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"

# Redaction patterns and their replacements, in order of application.
REDACTIONS = [
    (r"[A-Za-z]:[\\/][^:\s]+", "[protected-path]"),
    (r"/(?:var|tmp|home|etc|usr|opt|repositories|app)/[^\s:]+", "[protected-path]"),
    (
        r"(?:ghp_[a-zA-Z0-9]{36}|github_pat_[a-zA-Z0-9_]{82}|sk-[a-zA-Z0-9]{20,})",
        "[protected-token]",
    ),
    (r"(?i)x-api-key[:=]\s*[^\s,;]+", "X-API-Key: [protected-key]"),
]
BEARER = (r"Bearer\s+[A-Za-z0-9_\-\.]+", "[REDACTED_TOKEN]")
# Reference shapes.
OWNER_REPO = r"^([a-zA-Z0-9_.-]+)/([a-zA-Z0-9_.-]+)$"
PR_URL = (
    r"(?i)^(?:https?://)?(?:www\.)?github\.com/([a-zA-Z0-9_.-]+)/([a-zA-Z0-9_.-]+)/pull/(\d+)"
    r"(?:[/?#].*)?$"
)
LINE_RANGE = r"(?i)^\s*L?(\d+)(?:\s*-\s*L?(\d+))?\s*$"


def strip(text: Column) -> Column:
    """Trim all white space, line breaks included."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def lines_of(text: Column) -> Column:
    """Array of lines without their breaks; a final break adds no empty line."""
    body = F.regexp_replace(text, f"(?:{LINE_BREAK})\\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_BREAK))


def parse_line_range(text: Column) -> dict[str, Column]:
    """Start, end (ordered) and validity of a citation such as ``L40-L45`` or ``12``."""
    clean = strip(text)
    first = F.regexp_extract(clean, LINE_RANGE, 1).try_cast("bigint")
    second = F.coalesce(F.regexp_extract(clean, LINE_RANGE, 2).try_cast("bigint"), first)
    valid = F.coalesce(clean.rlike(LINE_RANGE), F.lit(False))
    return {
        "range_start": F.least(first, second),
        "range_end": F.greatest(first, second),
        "range_valid": valid,
    }


def strip_code_fence(text: Column) -> Column:
    """Content of a fenced block; an unclosed or trailed fence loses its marker lines only."""
    clean = strip(text)
    fence = r"(?is)^```(?:json)?\s*\n?(.*?)\n?```$"
    lines = lines_of(clean)
    body = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    closed = (F.size(body) > 0) & (strip(F.element_at(body, -1)) == "```")
    kept = F.when(closed, F.slice(body, 1, F.greatest(F.size(body) - 1, F.lit(0)))).otherwise(body)
    return (
        F.when(clean.rlike(fence), strip(F.regexp_extract(clean, fence, 1)))
        .when(F.startswith(clean, F.lit("```")), strip(F.array_join(kept, "\n")))
        .otherwise(clean)
    )


def redact(text: Column) -> Column:
    """Hide paths, access tokens and API keys in a text."""
    out = text
    for pattern, replacement in REDACTIONS:
        out = F.regexp_replace(out, "(?U)" + pattern, replacement)
    return out


def redact_header(text: Column) -> Column:
    """Drop everything from an authorization header on, and hide bearer tokens."""
    cut = F.substring_index(text, "Authorization", 1)
    head = F.when(F.contains(text, F.lit("Authorization")), strip(cut)).otherwise(text)
    return strip(F.regexp_replace(head, "(?U)" + BEARER[0], BEARER[1]))


def parse_pr_reference(ref: Column, number: Column) -> dict[str, Column]:
    """Owner, repository and number of a PR URL, or of ``owner/repo`` plus a number."""
    clean = strip(F.coalesce(ref, F.lit("")))
    from_url = clean.rlike(PR_URL)
    from_name = clean.rlike(OWNER_REPO)
    given = number.try_cast("bigint")
    chosen = F.when(from_url, F.regexp_extract(clean, PR_URL, 3).try_cast("bigint")).otherwise(given)
    reason = (
        F.when(clean == "", "empty")
        .when(from_url, None)
        .when(~from_name, "invalid_repository")
        .when(number.isNull(), "missing_number")
        .when(given.isNull(), "invalid_number")
        .when(given <= 0, "non_positive_number")
    )
    keep = reason.isNull()

    def part(group: int) -> Column:
        picked = F.when(from_url, F.regexp_extract(clean, PR_URL, group)).otherwise(
            F.regexp_extract(clean, OWNER_REPO, group)
        )
        return F.when(keep, picked)

    return {
        "owner": part(1),
        "repository": part(2),
        "number": F.when(keep, chosen),
        "reject_reason": reason,
    }


def author_display(author: Column) -> Column:
    cut = strip(F.substring_index(author, "<", 1))
    return F.when(F.contains(author, F.lit("<")), cut).otherwise(author)


def message_display(message: Column) -> Column:
    """First line of a message, cut to 57 characters plus dots beyond 60."""
    first = strip(F.coalesce(F.get(lines_of(F.coalesce(message, F.lit(""))), 0), F.lit("")))
    return F.when(F.length(first) > 60, F.concat(F.substring(first, 1, 57), F.lit("..."))).otherwise(
        first
    )


def badge_columns(level: Column, above: Column, threshold: float = PRODUCTION_THRESHOLD) -> dict[str, Column]:
    """Presentation fields of a risk level and its threshold status.

    Fixed values: the icons, colours and texts.
    """
    known = F.upper(strip(level))
    norm = F.when(known.isin("HIGH", "MEDIUM", "LOW"), known).otherwise("UNKNOWN")
    hot = F.coalesce(above, F.lit(False))
    icon = (
        F.when(norm.isin("HIGH", "MEDIUM"), F.when(hot, "⚠️").otherwise("ℹ️"))
        .when(norm == "LOW", F.when(hot, "⚠️").otherwise("✅"))
        .otherwise("ℹ️")
    )
    return {
        "norm_level": norm,
        "color": F.when(norm == "HIGH", "red")
        .when(norm == "MEDIUM", "amber")
        .when(norm == "LOW", "green")
        .otherwise("gray"),
        "icon": icon,
        "badge_text": F.concat_ws(" ", icon, norm),
        "label": F.when(hot, "Elevated Defect Risk").otherwise("Standard Risk Change"),
        "threshold_status": F.when(hot, f"Above Threshold (>= {threshold:.2f})").otherwise(
            f"Below Threshold (< {threshold:.2f})"
        ),
    }


def score_text(p: Column) -> Column:
    """Score with four decimals."""
    return F.format_string("%.4f", round_exact(p, 4))
