"""Review documents: validation of JSON texts and checking of their citations against diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from changerisk.functions.paths import forward_slashes
from changerisk.functions.text import parse_line_range, strip, strip_code_fence
from changerisk.operators.ranges import overlap_exists
from changerisk.session import materialize, worked_out

KEY = ["repo", "full_hash"]
# The document contract.
REQUIRED_KEYS = [
    "summary",
    "key_changes",
    "potential_risk_factors",
    "affected_areas",
    "testing_observations",
    "recommended_review_actions",
]
STRING_LISTS = ["key_changes", "affected_areas", "testing_observations"]
FACTOR_KEYS = ["category", "description", "review_priority", "file_path"]
FACTOR_FIELDS = [*FACTOR_KEYS, "line_range", "evidence_snippet"]
ACTION_FIELDS = ["action", "target_file"]
PRIORITIES = ["LOW", "MEDIUM", "HIGH"]

REVIEW_TYPE = (
    "struct<commit_hash:string, summary:string, key_changes:array<string>, "
    "potential_risk_factors:array<struct<category:string, description:string, "
    "review_priority:string, file_path:string, line_range:string, evidence_snippet:string>>, "
    "affected_areas:array<string>, testing_observations:array<string>, "
    "recommended_review_actions:array<struct<action:string, target_file:string>>, "
    "confidence_notes:string, model_provider:string, model_name:string>"
)


def _kind(v: Column) -> Column:
    """Type word of a variant: STRING, BIGINT, OBJECT, ARRAY, VOID ...; null when absent."""
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(_kind(v) == kind, F.lit(False))


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _list(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "array<variant>")


def _keys(v: Column) -> Column:
    return F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))


def _first(reasons: Column) -> Column:
    return F.try_element_at(F.filter(reasons, lambda r: r.isNotNull()), F.lit(1))


def _factor_reason(rf: Column) -> Column:
    missing = F.lit(False)
    for key in FACTOR_KEYS:
        missing = missing | _field(rf, key).isNull()
    priority = F.try_variant_get(rf, "$.review_priority", "string")
    line_range, snippet = _field(rf, "line_range"), _field(rf, "evidence_snippet")
    return (
        F.when(~_is(rf, "OBJECT"), "factor_not_object")
        .when(missing, "factor_missing_field")
        .when(
            ~(
                _is(_field(rf, "category"), "STRING")
                & _is(_field(rf, "description"), "STRING")
                & _is(_field(rf, "file_path"), "STRING")
            ),
            "factor_field_type",
        )
        .when(
            ~_is(_field(rf, "review_priority"), "STRING") | ~priority.isin(PRIORITIES),
            "factor_priority",
        )
        .when(
            line_range.isNotNull() & ~_is(line_range, "STRING") & ~_is(line_range, "VOID"),
            "factor_line_range_type",
        )
        .when(snippet.isNotNull() & ~_is(snippet, "STRING"), "factor_snippet_type")
    )


def _factor_shape(rf: Column) -> Column:
    allowed = F.array(*[F.lit(f) for f in [*FACTOR_FIELDS, "evidence_verified"]])
    extra = F.size(F.array_except(_keys(rf), allowed)) > 0
    return F.when(
        extra | _field(rf, "line_range").isNull() | _field(rf, "evidence_snippet").isNull(),
        "factor_fields",
    )


def _action_reason(ra: Column) -> Column:
    target = _field(ra, "target_file")
    return (
        F.when(~_is(ra, "OBJECT"), "action_not_object")
        .when(~_is(_field(ra, "action"), "STRING"), "action_missing_action")
        .when(
            target.isNotNull() & ~_is(target, "STRING") & ~_is(target, "VOID"), "action_target_type"
        )
    )


def _action_shape(ra: Column) -> Column:
    allowed = F.array(*[F.lit(f) for f in ACTION_FIELDS])
    return F.when(F.size(F.array_except(_keys(ra), allowed)) > 0, "action_fields")


def review_reject_reason(raw: Column, v: Column) -> Column:
    """First contract rule a document breaks; null for a valid one."""
    missing = F.lit(False)
    for key in REQUIRED_KEYS:
        missing = missing | _field(v, key).isNull()
    reason = (
        F.when(raw.isNull() | (strip(raw) == ""), "empty")
        .when(v.isNull(), "invalid_json")
        .when(~_is(v, "OBJECT"), "not_object")
        .when(missing, "missing_field")
        .when(~_is(_field(v, "summary"), "STRING"), "summary_type")
    )
    for name in STRING_LISTS:
        items = _list(v, name)
        reason = reason.when(~_is(_field(v, name), "ARRAY"), f"{name}_not_list").when(
            F.exists(items, lambda x: ~_is(x, "STRING")), f"{name}_element_type"
        )
    factors, actions = _list(v, "potential_risk_factors"), _list(v, "recommended_review_actions")
    bad_factor = _first(F.transform(factors, _factor_reason))
    bad_action = _first(F.transform(actions, _action_reason))
    shape = F.coalesce(
        _first(F.transform(factors, _factor_shape)), _first(F.transform(actions, _action_shape))
    )
    return (
        reason.when(~_is(_field(v, "potential_risk_factors"), "ARRAY"), "risk_factors_not_list")
        .when(bad_factor.isNotNull(), bad_factor)
        .when(~_is(_field(v, "recommended_review_actions"), "ARRAY"), "actions_not_list")
        .when(bad_action.isNotNull(), bad_action)
        .when(shape.isNotNull(), shape)
    )


def parse_reviews(reviews: DataFrame) -> DataFrame:
    """Add ``reject_reason`` and the typed ``review`` (null when rejected).

    ``reviews``: repo, full_hash, raw_text. The row's own hash overrides the one in the document.
    """
    clean = strip_code_fence(F.coalesce("raw_text", F.lit("")))
    staged = reviews.withColumn("_clean", clean).withColumn("_v", F.try_parse_json("_clean"))
    reason = review_reject_reason(F.col("raw_text"), F.col("_v"))
    judged = staged.withColumn("reject_reason", reason).withColumn(
        "_r", F.when(F.col("reject_reason").isNull(), F.from_json("_clean", REVIEW_TYPE))
    )
    hash_ = F.coalesce(
        F.nullif("full_hash", F.lit("")), F.nullif(F.col("_r.commit_hash"), F.lit("")), F.lit("unknown")
    )
    review = F.struct(
        hash_.alias("commit_hash"),
        *[f"_r.{f}" for f in REQUIRED_KEYS],
        F.coalesce("_r.confidence_notes", F.lit("")).alias("confidence_notes"),
        F.coalesce("_r.model_provider", F.lit("unknown")).alias("model_provider"),
        F.coalesce("_r.model_name", F.lit("unknown")).alias("model_name"),
    )
    return judged.withColumn("review", F.when(F.col("_r").isNotNull(), review)).drop(
        "_clean", "_v", "_r"
    )


def risk_factors(parsed: DataFrame) -> DataFrame:
    """One row per risk factor of the accepted documents.

    The parsed documents are stored first: the rows below are joined several times, and pushing
    a filter through the contract checks would repeat them.
    """
    kept = materialize(parsed.select(*KEY, F.col("review.potential_risk_factors").alias("_f")))
    return kept.select(*KEY, F.posexplode("_f").alias("factor_no", "f")).select(
        *KEY, "factor_no", "f.*"
    )


def _endings(rows: DataFrame, path: str, other: DataFrame, of: str, out: str) -> DataFrame:
    """``rows`` with the endings of ``path`` that are as long as some ``of`` path of the commit in ``other``."""
    sizes = other.groupBy(*KEY).agg(F.collect_set(F.length(of)).alias("_sizes"))
    size = F.explode(F.filter("_sizes", lambda n: n <= F.length(path)))
    sized = rows.join(sizes, KEY).withColumn("_size", size)
    return sized.withColumn(out, F.substring(F.col(path), F.length(path) - F.col("_size") + 1, F.col("_size"))).drop("_sizes", "_size")


def match_cited_file(factors: DataFrame, files: DataFrame) -> DataFrame:
    """First file, in diff order, whose path the citation names exactly or as a suffix.

    The suffix test runs either way. A path gives its endings only of the lengths that the other
    side's paths of its commit have, and these are joined to the whole paths, so only true matches
    meet; the rows are files times distinct lengths cited, and citations times distinct lengths of
    paths.
    """
    target = forward_slashes(F.col("file_path"))
    cited = factors.withColumn("_t", target).where(F.col("_t") != "").select(*KEY, "factor_no", "_t")
    norm = files.select(
        *KEY, "file_ord", forward_slashes(F.col("new_path")).alias("_n"),
        forward_slashes(F.col("old_path")).alias("_o"),
    ).join(cited.select(*KEY).distinct(), KEY, "left_semi")
    named = norm.where(F.col("_n") != "").select(*KEY, "file_ord", "_n")
    by_old = cited.join(norm.select(*KEY, "file_ord", F.col("_o").alias("_t")), [*KEY, "_t"])
    file_ends = cited.join(_endings(named, "_n", cited, "_t", "_t").drop("_n"), [*KEY, "_t"])
    cited_ends = _endings(cited, "_t", named, "_n", "_n").join(named, [*KEY, "_n"])
    cols = [*KEY, "factor_no", "file_ord"]
    hits = by_old.select(*cols).unionByName(file_ends.select(*cols)).unionByName(cited_ends.select(*cols))
    first = hits.groupBy(*KEY, "factor_no").agg(F.min("file_ord").alias("file_ord"))
    return factors.join(first, [*KEY, "factor_no"], "left")


def hunk_extents(files: DataFrame) -> DataFrame:
    """Old and new line ranges of every hunk: the header's, or longer if the lines say so."""
    n = lambda kinds: F.size(
        F.filter(F.col("h.lines"), lambda x: x["line_type"].isin(*kinds))
    )
    # A plain explode would add a filter on the hunks that cuts the text once more.
    rows = files.select(*KEY, "file_ord", F.explode_outer("hunks").alias("h"))

    def side(start: str, count: str, kinds: tuple[str, ...]):
        length = F.greatest(F.col(f"h.{count}"), n(kinds).cast("bigint"))
        return F.struct(
            F.col(f"h.{start}").alias("first_line"),
            (F.col(f"h.{start}") + length - 1).alias("last_line"),
        )

    both = F.array(side("old_start", "old_lines", ("-", " ")), side("new_start", "new_lines", ("+", " ")))
    return rows.select(*KEY, "file_ord", F.inline(both)).where("last_line >= first_line")


def file_contents(files: DataFrame) -> DataFrame:
    """Contents of the diff lines of each file, in order."""
    lines = F.flatten(F.transform("hunks", lambda h: F.transform(h["lines"], lambda x: x["content"])))
    return worked_out(files, contents=lines).select(*KEY, "file_ord", "contents")


def snippet_found(snippet: Column, contents: Column, compat: bool = False) -> Column:
    """Snippet inside the joined lines, or a stripped line inside the snippet.

    A blank line counts only with ``compat=True``, where it verifies any snippet.
    """

    def line_in(x: Column) -> Column:
        bare = strip(x)
        hit = F.contains(snippet, bare)
        return hit if compat else hit & (bare != "")

    joined = F.array_join(contents, "\n")
    return F.contains(joined, snippet) | F.exists(contents, line_in)


def verify_evidence(factors: DataFrame, files: DataFrame, compat: bool = False) -> DataFrame:
    """Add ``file_ord`` of the cited file and ``evidence_verified``; no row is dropped.

    Verified means: a file matches, a given line range is valid and overlaps a hunk, and a given
    snippet is found in that file's diff. The files are stored once, as four joins read them.
    """
    files = materialize(files.select(*KEY, "file_ord", "old_path", "new_path", "hunks"))
    matched = materialize(
        match_cited_file(factors, files).withColumns(parse_line_range(F.col("line_range")))
    )
    has_range = F.coalesce(strip(F.col("line_range")) != "", F.lit(False))
    snippet = F.coalesce(strip(F.col("evidence_snippet")), F.lit(""))
    matched = matched.withColumns({"_has_range": has_range, "_snippet": snippet})
    ranged = matched.where(F.col("_has_range") & F.col("range_valid") & F.col("file_ord").isNotNull())
    overlap = overlap_exists(
        ranged.select(*KEY, "file_ord", "factor_no", "range_start", "range_end"),
        hunk_extents(files),
        [*KEY, "file_ord"],
        ("range_start", "range_end"),
        ("first_line", "last_line"),
        "_overlaps",
    ).select(*KEY, "factor_no", "_overlaps")
    texts = file_contents(files)
    found = (
        matched.where(F.col("_snippet") != "")
        .select(*KEY, "factor_no", "file_ord", "_snippet")
        .join(texts, [*KEY, "file_ord"])
        .select(*KEY, "factor_no", snippet_found(F.col("_snippet"), F.col("contents"), compat).alias("_found"))
    )
    no = F.lit(False)
    return (
        matched.join(overlap, [*KEY, "factor_no"], "left")
        .join(found, [*KEY, "factor_no"], "left")
        .withColumn(
            "evidence_verified",
            F.col("file_ord").isNotNull()
            & (~F.col("_has_range") | F.coalesce("_overlaps", no))
            & ((F.col("_snippet") == "") | F.coalesce("_found", no)),
        )
        .drop("_has_range", "_snippet", "_overlaps", "_found")
    )
