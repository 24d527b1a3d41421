"""Nearest neighbours and integer k-means against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from changerisk.llm import ann
from changerisk.llm.ann import nearest_neighbours
from changerisk.llm.centroids import cluster_vectors, nearest, vantage_tree

NAN, INF = float("nan"), float("inf")
BIG = 2**60 + 1


@pytest.fixture
def vectors(spark):
    def make(rows, kind="float"):
        ddl = f"vec_id long, embedding array<{kind}>, label int, row long, leaf string, cluster int, v string, distance double"
        return spark.createDataFrame([(i, v, 1, 2, "x", 3, "y", 0.5) for i, v in rows], ddl)

    return make


def clouds(n, dims=64, seed=3, spread=0.4):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, dims))
    x = middle[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, dims))
    return [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]


ODD = [(None, None), (50, None), (None, [1.0] * 64), (100, [0.0] * 64), (150, [NAN] + [1.0] * 63), (200, [INF] + [1.0] * 63), (250, [None] + [1.0] * 63), (300, []), (350, [1.0, 2.0])]


def brute(rows, k=5):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = {}
    for a, (q, x) in enumerate(ok):
        if q is None or q % 50:
            continue
        score = [((x @ y) / math.sqrt(x @ x) / math.sqrt(y @ y), i) for b, (i, y) in enumerate(ok) if b != a and len(x) == len(y)]
        out.setdefault(q, []).append(sorted(score, key=lambda s: (-round(s[0], 12), s[1] is None, s[1] or 0))[:k])
    return out


def asked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


@pytest.mark.parametrize("spread", [0.3, 3.0])
def test_recall_and_exact_scores(vectors, spread):
    rows = clouds(3000, spread=spread)
    by_id = {i: np.array(v) for i, v in rows}
    got, want = asked(nearest_neighbours(vectors(rows))), brute(rows)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and q not in {f[1] for f in found}
        assert [f[2] for f in found] == sorted((f[2] for f in found), reverse=True)
        for _, i, s in found:
            x, y = by_id[q], by_id[i]
            assert abs(s - (x @ y) / math.sqrt(x @ x) / math.sqrt(y @ y)) < 1e-12
        hits += len({f[1] for f in found} & {i for _, i in want[q][0]})
    assert hits >= 0.9 * 5 * len(want)


def test_copies_ties_and_odd_vectors(vectors):
    same, other = [0.1 * i for i in range(1, 65)], [0.1 * (65 - i) for i in range(1, 65)]
    rows = [(i, same) for i in range(0, 400)] + [(BIG, other), (BIG + 1, [2.0 * x for x in other]), (50 * 30, other), (50 * 30, other)] + ODD
    got, want = asked(nearest_neighbours(vectors(rows))), brute(rows)
    assert set(got) == set(want)
    assert [f[1] for f in got[0]] == [1, 2, 3, 4, 5] and [f[1] for f in got[50]] == [0, 1, 2, 3, 4]
    assert sorted(f[1] for f in got[1500][:6]) == sorted([1500, BIG, BIG + 1, 1500, BIG, BIG + 1])
    assert got[0][0][2] == pytest.approx(1.0)


def test_fewer_candidates_than_asked(vectors):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 3.0])]
    assert [f[1] for f in asked(nearest_neighbours(vectors(rows)))[0]] == [1, 2]
    assert nearest_neighbours(vectors([])).count() == 0 and nearest_neighbours(vectors([(0, [1.0])])).count() == 0


def test_large_and_small_doubles(vectors):
    rows = [(0, [1e300, 1e300]), (1, [1e-300, 1e-300]), (2, [1e300, -1e300]), (3, [5e-324, 0.0])]
    found = asked(nearest_neighbours(vectors(rows, "double")))[0]
    assert [f[1] for f in found] == [1, 3, 2] and found[0][2] == pytest.approx(1.0)


def test_small_pages_and_blocks_give_the_same(vectors, monkeypatch):
    rows = clouds(1200, dims=8)
    want = asked(nearest_neighbours(vectors(rows)))
    monkeypatch.setattr(ann, "BLOCK_ROWS", 5)
    monkeypatch.setattr(ann, "_pages", lambda sizes, f=ann._pages: f(sizes, 16))
    assert asked(nearest_neighbours(vectors(rows))) == want


def whole(rows, k, rounds, dims):
    ok = [(i, [math.floor(256 * max(min(float(np.float32(c)), 2**19), -(2**19))) for c in v]) for i, v in rows
          if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(ok, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]
    place = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        at = [place(v)[1] for _, v in ok]
        for n in range(len(cents)):
            mine = [v for (_, v), a in zip(ok, at) if a == n]
            if mine:
                cents[n] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [(i, *place(v)) for i, v in ok]
    total = sum(f[1] for f in found)
    return sorted(((i, n, d, sum(f[1] for f in found if f[2] == n), total, hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest()) for i, d, n in found), key=repr)


@pytest.mark.parametrize("rows", [clouds(300), clouds(25), clouds(60) + clouds(60) + ODD + [(BIG, [0.5] * 64), (None, [-7e5] * 64)], []], ids=["plain", "few", "odd", "none"])
def test_clusters_equal_plain_python(vectors, rows):
    got = sorted((tuple(r) for r in cluster_vectors(vectors(rows)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)
    assert got == whole(rows, 40, 5, 64)


def test_tree_finds_the_smallest_number_of_ties():
    rng = random.Random(2)
    for dims in (1, 2, 5):
        cents = np.array([[rng.randint(-3, 3) for _ in range(dims)] for _ in range(37)], np.int64)
        x = np.array([[rng.randint(-4, 4) for _ in range(dims)] for _ in range(500)], np.int64)
        number, d = nearest(x, cents, vantage_tree(cents))
        gaps = ((x[:, None, :] - cents[None, :, :]) ** 2).sum(2)
        assert (d == gaps.min(1)).all() and (number == gaps.argmin(1)).all()
