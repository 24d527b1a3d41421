"""File-path expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Source-code extensions.
SOURCE_EXTENSIONS = [
    ".py", ".java", ".cpp", ".c", ".h", ".hpp", ".js", ".ts", ".jsx", ".tsx",
    ".go", ".rs", ".cs", ".rb", ".php", ".swift", ".kt", ".sh", ".ps1",
    ".html", ".css", ".scss", ".sql", ".scala", ".m", ".mm",
]
# Patterns of test files and of generated files, case-insensitive.
TEST_PATTERNS = [r"test_", r"_test\.", r"/tests?/", r"/spec/", r"Test\.java$", r"Spec\."]
GENERATED_PATTERNS = [
    r"package-lock\.json$", r"yarn\.lock$", r"pnpm-lock\.yaml$", r"cargo\.lock$", r"Gemfile\.lock$",
    r"\.min\.js$", r"\.min\.css$", r"\.map$", r"\.generated\.", r"\.pb\.go$", r"swagger\.json$",
]
# Fixed value: the rename pattern of the compatibility mode.
RENAME_COMPAT = r"^(.*?)(?:\{.*?=>\s*(.*?)\}|(\S+)\s*=>\s*(\S+))(.*)$"


def any_of(patterns: list[str]) -> str:
    return "(?i)" + "|".join(patterns)


def clean_rename_path(path: Column, compat: bool = False) -> Column:
    """New path of a numstat rename (``a => b`` or ``dir/{a => b}/f``); other paths are trimmed.

    ``compat=True`` lets the arrow alternative win over a braced one that does not start the
    string, as the original pattern does.
    """
    if compat:
        moved = F.regexp_replace(path, RENAME_COMPAT, "$1$2$4$5")
    else:
        braced = F.regexp_replace(path, r"^(.*?)\{.*?=>\s*(.*?)\}(.*)$", "$1$2$3")
        plain = F.regexp_replace(path, r"^.*?=>\s*(.*)$", "$1")
        moved = F.when(path.rlike(r"\{.*=>.*\}"), braced).otherwise(plain)
    collapsed = F.replace(moved, F.lit("//"), F.lit("/"))
    return F.trim(F.when(F.contains(path, F.lit("=>")), collapsed).otherwise(path))


def directory_of(path: Column) -> Column:
    """Directory part, ``.`` for a top-level file."""
    return F.coalesce(F.nullif(F.regexp_extract(path, "^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))


def extension_of(path: Column) -> Column:
    """Lower-cased extension with its dot; a name that only starts with dots has none."""
    return F.lower(F.regexp_extract(path, r"[^./][^/]*(\.[^./]*)$", 1))


def is_source_file(path: Column) -> Column:
    return extension_of(path).isin(SOURCE_EXTENSIONS)


def is_test_file(path: Column) -> Column:
    return path.rlike(any_of(TEST_PATTERNS))


def forward_slashes(path: Column) -> Column:
    return F.replace(F.trim(path), F.lit("\\"), F.lit("/"))


def is_generated_file(path: Column) -> Column:
    return forward_slashes(path).rlike(any_of(GENERATED_PATTERNS))


def file_priority(is_binary: Column, is_generated: Column) -> Column:
    """Rank for context packing: source 1, generated 3, binary 4."""
    return F.when(is_binary, 4).when(is_generated, 3).otherwise(1)
