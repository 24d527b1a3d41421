import re

from changerisk.llm.mixing import budget_cuts, mix_sources, mixed_rows, source_targets


def shared_out(sizes):
    """The targets by the words of the task: share, stop, reshare the excess by weight."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    left, open_ = 1.5 * sum(sizes.values()), set(names)
    for _ in range(200):
        total = sum(weight[s] for s in open_)
        if not total or left < 1e-9:
            break
        for s in open_:
            target[s] += left * weight[s] / total
        left = sum(max(0.0, target[s] - 2 * sizes[s]) for s in open_)
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_targets_are_shared_out(spark):
    sizes = {"b": 10, "a": 1000, "z": 300, "é": 5000, None: 70, "src10": 20, "src2": 4}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    want = shared_out(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_cuts_match_a_running_sum(spark, prose):
    import random

    rng = random.Random(2)
    rows = [(g, rng.choice([rng.getrandbits(48), 77]), rng.randint(0, 50)) for g in ("x", None) for _ in range(300)]
    budgets = {"x": 2500.5, None: 1e9}
    cuts = {r.group: r.cut for r in budget_cuts(spark.createDataFrame(rows, "group string, key long, weight long"), spark.createDataFrame(list(budgets.items()), "group string, budget double")).collect()}
    keys = sorted({k for g, k, _ in rows if g == "x"})
    taken = lambda cut: sum(w for g, k, w in rows if g == "x" and k <= cut)
    best = min(abs(taken(k) - budgets["x"]) for k in [-1, *keys])
    assert abs(taken(cuts["x"]) - budgets["x"]) == best
    assert cuts[None] >= max(k for _, k, _ in rows)


def test_mix_over_edges(documents, edge_rows, prose):
    rows = edge_rows + [(100 + i, t, None, "abc"[i % 3]) for i, t in enumerate(prose(200))]
    df = documents(rows)
    got = mix_sources(df).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r["size"] for r in got) == sorted(size(t) for _, t, _, _ in rows)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix_sources(df.repartition(7)).collect()), key=str)
    taken = {}
    for r in got:
        key = (r.source_size, r.target)
        taken[key] = taken.get(key, 0) + r.taken
    # The hot long document and repeated rows go as a whole.
    assert all(abs(t - target) <= 60_000 for (_, target), t in taken.items())


def test_rows_keep_their_columns_and_copies(documents, edge_rows):
    df = documents(edge_rows)
    got = mixed_rows(df)
    assert got.columns == [c for c in df.columns if c != "copies"] + ["copies"]
    assert {r.copies for r in got.collect()} <= {1, 2}


def test_empty(documents):
    assert mix_sources(documents([])).count() == 0
