"""Registered queries against their oracle SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from changerisk.plans.adapters import TABLES

FOLDER = "/root/testdata/sf0.001"
NAMES = ["a1_commit_features", "j3_hunk_origins", "j4_labels", "w1_temporal_split", "j12_threshold_sweep", "a13_average_precision",
         "w4_operating_points", "a17_pr_summary", "n3_diff_lines", "n9_pr_payloads", "p8_fix_signals"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    fix = lambda v: float(f"{v:.9g}") if isinstance(v, float) and not math.isnan(v) else v
    return sorted(cols), sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    rel = duck.execute(entry.oracle_sql()[name])
    assert table(df.columns, df.collect()) == table([d[0] for d in rel.description], rel.fetchall())


def test_registry_is_complete():
    names, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(names)
    ids = {n.split("_")[0] for n in names}
    for family, last, missing in (("p", 29, set()), ("f", 8, set()), ("j", 12, set()), ("a", 20, set()), ("w", 11, {8, 9}),
                                  ("u", 5, set()), ("g", 6, set()), ("n", 10, set()), ("m", 15, set()), ("st", 5, set()), ("s", 10, set())):
        want = {f"{family}{i}" for i in range(1, last + 1) if i not in missing}
        assert want <= ids, (family, sorted(want - ids))


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
