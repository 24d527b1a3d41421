import random

from pyspark.sql import functions as F

from changerisk.functions import commits as fc, paths as fp, scoring as fs, text as ft
from changerisk.functions.rounding import round_exact


def test_rename_paths(one):
    paths = ["old_dir/{a => b}.py", "a.py => b.py", "{lib => }/x.py", "d/{ => sub}/f.c", " p.py "]
    assert one(paths, lambda x: fp.clean_rename_path(F.col(x))) == [
        "old_dir/b.py", "b.py", "/x.py", "d/sub/f.c", "p.py",
    ]
    # the compatible pattern lets the arrow win unless the brace starts the string
    assert one(paths[:3], lambda x: fp.clean_rename_path(F.col(x), compat=True)) == ["b}.py", "b.py", "/x.py"]


def test_directory_and_extension(one):
    assert one(["a/b/c.py", "c.py"], lambda x: fp.directory_of(F.col(x))) == ["a/b", "."]
    names = ["a/X.PY", ".sh", "a/.hidden", "..a.py", "noext", "a.b/c", "x.tar.gz"]
    assert one(names, lambda x: fp.extension_of(F.col(x))) == [".py", "", "", ".py", "", "", ".gz"]


def test_test_and_generated_files(one):
    names = ["test_a.py", "latest_x", "tests/a.py", "a/tests/b", "FooTest.java", "FooTest.javax", "a_spec.rb"]
    assert one(names, lambda x: fp.is_test_file(F.col(x))) == [True, True, False, True, True, False, True]
    names = ["x/package-lock.json", "a.MIN.js", "b\\c.map", "a.generated.cs", "main.py"]
    assert one(names, lambda x: fp.is_generated_file(F.col(x))) == [True, True, True, True, False]


def test_fix_signals_and_ids(one):
    subjects = ["Fix GH-42 crash", "Fix #88 thing", "issue #88 seen", "x#9 and JIRA-1, gh-2", "préfix only", "prefix"]
    assert one(subjects, lambda x: fc.has_fix_keyword(F.col(x))) == [True, True, True, False, False, False]
    assert one(subjects, lambda x: F.array_join(fc.issue_ids(F.col(x)), ",")) == [
        "GH-42", "", "issue #88", "#9,JIRA-1,gh-2", "", "",
    ]
    reverts = ["Revert x", "reverting", "not Revert x", "reverts it"]
    assert one(reverts, lambda x: fc.is_revert(F.col(x))) == [True, True, False, False]


def test_round_exact_equals_python(one):
    rng = random.Random(7)
    values = [0.265, 0.285, 0.275, 0.145, 0.575, 2.675, 0.125, 0.375, 1.005, -0.265, -2.5, 0.0, 57 / 160]
    values += [rng.randint(0, 4000) / rng.randint(1, 400) for _ in range(3000)]
    for digits in (2, 4):
        got = one(values, lambda x: round_exact(F.col(x), digits), "x double")
        assert got == [round(v, digits) for v in values]


def test_risk_levels_and_errors(spark, one):
    assert one([0.0, 0.3499, 0.35, 0.5999, 0.6], lambda x: fs.risk_level(F.col(x)), "x double") == [
        "LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH",
    ]
    df = spark.createDataFrame([(1, 1), (0, 0), (0, 1), (1, 0)], "a int, b int")
    assert [r[0] for r in df.select(fs.error_type(F.col("a"), F.col("b"))).collect()] == ["TP", "TN", "FP", "FN"]


def test_factor_orders(spark):
    df = spark.range(1).select(
        fs.contributions([F.lit(2.0), F.lit(-3.0), F.lit(0.0), F.lit(5.0)], [1.0, 1.0, 1.0, 0.4], list("abcd")).alias("f")
    )
    row = df.select(
        fs.factors_text(fs.top_positive(F.col("f"))), fs.factors_text(fs.top_negative(F.col("f"))),
        fs.factors_text(fs.by_magnitude(F.col("f"))),
    ).first()
    assert tuple(row) == ("a=2.0000,d=2.0000", "b=-3.0000", "b=-3.0000,a=2.0000,d=2.0000,c=0.0000")


def test_line_ranges(spark):
    df = spark.createDataFrame([("L40-L45",), (" l9 - 3 ",), ("10",), ("10-",), ("",), (None,)], "r string")
    rows = df.select(*[v.alias(k) for k, v in ft.parse_line_range(F.col("r")).items()]).collect()
    assert [(r.range_start, r.range_end, r.range_valid) for r in rows] == [
        (40, 45, True), (3, 9, True), (10, 10, True), (None, None, False), (None, None, False), (None, None, False),
    ]


def test_code_fences(one):
    texts = ['```json\n{"a": 1}\n```', "```\nx\n```", "```python\nx\n```", "```\nopen", "plain", "```\na\n``` tail"]
    assert one(texts, lambda x: ft.strip_code_fence(F.col(x))) == [
        '{"a": 1}', "x", "python\nx", "open", "plain", "a\n``` tail",
    ]


def test_redaction(one):
    texts = ["at C:\\u\\a.txt: x", "see /home/u/x y", "k ghp_" + "a" * 36, "X-Api-Key=abc;", "sk-" + "b" * 20, "/srv/x"]
    assert one(texts, lambda x: ft.redact(F.col(x))) == [
        "at [protected-path]: x", "see [protected-path] y", "k [protected-token]", "X-API-Key: [protected-key];",
        "[protected-token]", "/srv/x",
    ]
    assert one(["a Bearer x.y-z b", "pre Authorization: q"], lambda x: ft.redact_header(F.col(x))) == ["a [REDACTED_TOKEN] b", "pre"]


def test_pr_references(spark):
    rows = [
        ("https://github.com/o/r/pull/42/files", None), ("GitHub.com/o-w/r.x/pull/7?x", "9"), ("o/r", "5"), ("o/r", None),
        ("o/r", "x"), ("o/r", "0"), ("o", "1"), ("", "1"),
    ]
    df = spark.createDataFrame(rows, "ref string, n string")
    got = df.select(*[v.alias(k) for k, v in ft.parse_pr_reference(F.col("ref"), F.col("n")).items()]).collect()
    assert [tuple(r) for r in got] == [
        ("o", "r", 42, None), ("o-w", "r.x", 7, None), ("o", "r", 5, None), (None, None, None, "missing_number"),
        (None, None, None, "invalid_number"), (None, None, None, "non_positive_number"),
        (None, None, None, "invalid_repository"), (None, None, None, "empty"),
    ]


def test_git_refs(one):
    refs = ["main", " ", "-n", "a b", "a..b", "x@{1}", "a//b", "a/", "v1.", "a\\b", "feature/x-1"]
    assert one(refs, lambda x: fc.ref_reject_reason(F.col(x))) == [
        None, "empty", "leading_hyphen", "whitespace_or_control", "prohibited_sequence ..", "prohibited_sequence @{",
        "prohibited_sequence //", "bad_ending", "bad_ending", "prohibited_sequence \\", None,
    ]


def test_instants(one):
    got = one(
        ["2020-01-01T00:00:00+02:00", "2020-01-01T00:00:00Z", "2020-01-01T00:00:00", "bad"],
        lambda x: F.unix_seconds(fc.to_utc(F.col(x))),
    )
    assert got == [1577829600, 1577836800, 1577836800, None]


def test_display(one):
    assert one(["A B <a@x>", "plain"], lambda x: ft.author_display(F.col(x))) == ["A B", "plain"]
    assert one(["y" * 61 + "\nz", "short\nmore", None], lambda x: ft.message_display(F.col(x))) == ["y" * 57 + "...", "short", ""]
