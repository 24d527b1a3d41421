import random
import re
from collections import Counter

import numpy as np

from changerisk.llm.neardup import CHUNK, _dealt, classes, dart_signatures, elements, keep_one

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(t):
    w = WORD.findall((t or "").translate(LOWER))
    return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / max(1, sum((a | b).values()))


def brute(rows):
    sets, root = [runs(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and similarity(sets[i], sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, d), d)
    return sorted((d, least[r]) for (d, _), r in zip(rows, root, strict=True))


def families(prose, n=40, edits=12):
    rng = random.Random(9)
    rows = []
    for base in prose(n, seed=11, sizes=(40, 150)):
        rows.append(base)
        for _ in range(rng.randint(0, edits)):
            w = base.split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
            rows.append(" ".join(w))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_classes_match_brute_force(documents, prose):
    rows = families(prose) + [(900, "one two"), (901, "ONE two!"), (902, "one"), (903, "")]
    got = classes(documents([(d, t, None, None) for d, t in rows]))
    assert sorted((r.doc_id, r.class_id) for r in got.collect()) == brute(rows)


def test_a_large_bucket_is_dealt_and_loses_no_link(spark, documents, prose, monkeypatch):
    import changerisk.llm.neardup as m

    monkeypatch.setattr(m, "CHUNK", 4)
    monkeypatch.setattr(m, "LEADERS", 1)
    rows = families(prose, n=6, edits=30)
    got = classes(documents([(d, t, None, None) for d, t in rows]))
    assert sorted((r.doc_id, r.class_id) for r in got.collect()) == brute(rows)


def test_parts_are_bounded(spark):
    n = 4 * CHUNK
    rows = spark.createDataFrame([(bytes([i % 256, i // 256]), 5, n) for i in range(n)], "same binary, bucket long, n long")
    sizes = [r["count"] for r in _dealt(rows).groupBy("bucket", "part").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 2 * CHUNK


def test_signatures_agree_as_often_as_sets_do():
    rng = random.Random(1)
    words = [f"w{rng.randrange(400)}" for _ in range(300)]
    other = words[:40] + [f"v{rng.randrange(400)}" for _ in range(40)] + words[80:]
    texts = [" ".join(words), " ".join(other), " ".join(words + words)]
    d, cells = elements(texts)
    sig = dart_signatures(d, cells, 3, 2048)
    for i, j in ((0, 1), (0, 2)):
        want = similarity(runs(texts[i]), runs(texts[j]))
        assert abs((sig[i] == sig[j]).mean() - want) < 0.05
    # No coordinate is left empty, whatever the weight.
    d, cells = elements(["a b c d e", "", "x " * 5000])
    sig = dart_signatures(d, cells, 3, 120)
    assert (sig[[0, 2]] != 0).all() and not sig[1].any()
    assert np.array_equal(sig, dart_signatures(d, cells, 3, 120))


def test_edges(documents, edge_rows):
    df = documents(edge_rows)
    got = classes(df).collect()
    assert len(got) == len(edge_rows)
    by = {r.doc_id: r.class_id for r in got}
    assert by[7] == by[8] == 7 and by[2] == 2 and by[1] == 1 and by[3] == 3
    kept = keep_one(df)
    assert kept.columns == df.columns
    # Of the three equal texts one row stays; texts without words all stay.
    assert kept.count() == len(edge_rows) - 2
    assert [r.doc_id for r in kept.collect()].count(7) == 1
    assert classes(documents([])).count() == 0 and keep_one(documents([])).count() == 0
