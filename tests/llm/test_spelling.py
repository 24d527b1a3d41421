"""Spelling variants against plain Python over all words and all their edits."""

import random
import re
import zlib
from collections import Counter

import pytest

from changerisk.llm.spelling import LONGEST, group_spellings, neighbours, roots

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(n):
    near = {w: [v for v in n if v != w and one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], [ord(c) for c in v]), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def result(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def slips(rng, words, n):
    out = []
    for _ in range(n):
        w = rng.choice(words)
        if rng.random() < 0.3:
            i = rng.randrange(len(w))
            c = rng.choice("abcßéÀÿ")
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[:i] + c + w[i:]])
        out.append(w)
    return out


def test_words_forms_and_roots(documents, edge_rows):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 9))) for _ in range(25)] + ["Straße" * 2, "aaaaaaaa", "ÀÉÎÕÜß"]
    rows = [(i, ", ".join(slips(rng, words, 300)).title() if i % 3 else " ".join(slips(rng, words, 300)), "en", "a") for i in range(120)]
    rows = rows + edge_rows + rows[:3] + [(901, "zebraic " * 150 + "zebraix " * 30 + "zebracx " * 6, "en", "a")]
    got = result(group_spellings(documents(rows)))
    assert got == expected(counted([(r[0], r[1]) for r in rows]))
    assert any(r[1] for r in got) and ("zebracx", "zebraix", "zebraic", 6, 1, 30) in got


@pytest.mark.parametrize("size", [6, 7, LONGEST - 1, LONGEST, LONGEST + 1, 300])
def test_every_edit_at_every_place(spark, size):
    rng = random.Random(size)
    base = "".join(rng.choice("aabz") for _ in range(size))
    words = {base}
    for i in range(size + 1):
        words |= {base[:i] + c + base[i:] for c in "am"} | {base[:i] + c + base[i + 1 :] for c in "bÿ"} | {base[:i] + base[i + 1 :]}
    words = sorted(words if size < 100 else rng.sample(sorted(words), 120))
    got = {(r.word, r.near) for r in neighbours(spark.createDataFrame([(w, 5) for w in words], "word string, n long")).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and one_edit(a, b)}


def test_chains_of_forms(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(9)] + [("x", "w4"), ("y", "z")]
    got = {(r.word, r.root) for r in roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {(f"w{i}", "w9") for i in range(9)} | {("x", "w9"), ("y", "z")}


def test_empty_table(documents):
    assert group_spellings(documents([])).count() == 0
