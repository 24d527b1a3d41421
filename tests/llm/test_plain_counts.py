"""Fingerprints, quality importance and toxicity scores against versions that count with sets and dictionaries, a term at a time."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from changerisk.llm import fingerprints as fp, quality, toxicity as tx
from changerisk.llm.blocks import ALNUM, SOLID, hashes, mix, words


def mixed(x, seed):
    return int(mix(np.array([x], np.uint64), seed)[0])


def hashed(run, kind, lower=True):
    found = hashes(words([run.decode()], kind, lower))
    assert len(found) == 1
    return int(found[0])


# --- fingerprints ---------------------------------------------------------------------------------
def terms_of(text):
    return {hashed(w, ALNUM) for w in set(re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower()))}


def section(terms):
    """rate, and the hash of what each subset keeps of the terms, at each rate."""
    kept_bits = {t >> 16 for t in terms}
    rate = int(math.log2(len(kept_bits))) if kept_bits else -1
    subsets = []
    for k in range(fp.RATES):
        for s in range(fp.SUBSETS):
            kept = [t for t in kept_bits if mixed(t, 50 + s) / 2**64 < 2.0 ** -(rate + k)]
            total = sum(mixed(t, 41) for t in kept) % 2**64
            subsets.append(mixed(total, 42) % 0xFFFF + 1 if total else 0)
    return rate, len(kept_bits), subsets


def written(name, found):
    return "" if found[0] < 0 else f"{name}{found[0]}:" + "".join(f"{x:04x}" for x in found[2])


def fingerprint_of(text, inside):
    every = terms_of(text)
    band = section({t for t in every if t % fp.BUCKETS in inside})
    name = written("b", band)
    if band[1] < fp.FEW:
        name += written("a", section(every))
    return name, band, every


def likeness_of(one, two):
    if one[0] == two[0]:
        return 1.0
    a, b = one[1], two[1]
    if min(a[1], b[1]) < fp.FEW // 2:
        a, b = section(one[2]), section(two[2])
    if a[0] < 0 or b[0] < 0:
        return 0.0
    same = either = 0
    for k in range(fp.RATES):
        m = a[0] + k - b[0]
        if 0 <= m < fp.RATES:
            for s in range(fp.SUBSETS):
                x, y = a[2][k * fp.SUBSETS + s], b[2][m * fp.SUBSETS + s]
                same += x == y != 0
                either += (x or y) != 0
    return same / max(either, 1)


def test_fingerprints_match_sets(documents, prose):
    texts = prose(20, seed=8, sizes=(60, 160), syllables=("tha", "er", "on", "ing", "ble", "ré", "st", "ku", "wo", "zi", "pla", "dro"))
    texts += ["", None, "?!", "only five words stand here", texts[3], texts[4] + " Éxtra", *prose(4, seed=9, sizes=(1, 8))]
    df = documents([(i, t, "en", "s") for i, t in enumerate(texts)])
    band = (0.06, 0.5)
    plain = [t or "" for t in texts]
    held = Counter(b for t in plain for b in {h % fp.BUCKETS for h in terms_of(t)})
    inside = {b for b, n in held.items() if len(plain) * band[0] <= n <= len(plain) * band[1]}
    own = [fingerprint_of(t, inside) for t in plain]
    # All kinds of texts are here: many terms in the band, few of them, none at all.
    assert max(f[1][1] for f in own) >= fp.FEW and {f[1][0] for f in own} >= {-1} and any(0 < f[1][1] < fp.FEW for f in own)
    got = {r.doc_id: r for r in fp.compare_with_edits(df, band).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(plain):
        after = (i + 1) % len(plain)
        edited = fingerprint_of(text[: len(text) - len(text) // 4] + plain[after][: len(text) // 4], inside)
        r = got[i]
        assert (r.fingerprint, r.edited_fingerprint) == (own[i][0], edited[0])
        assert r.near_edited == pytest.approx(likeness_of(own[i], edited), abs=1e-12)
        assert r.near_next == pytest.approx(likeness_of(own[i], own[after]), abs=1e-12)


# --- quality --------------------------------------------------------------------------------------
def shape_of(run):
    up, digit = sum(65 <= b <= 90 for b in run), sum(48 <= b <= 57 for b in run)
    low = len(run) - up - digit
    if low == len(run):
        return 0
    if 65 <= run[0] <= 90 and up == 1:
        return 1
    if up and low + digit < up:
        return 2
    return 3 if digit == len(run) else 4


def grams_of(text):
    tokens, shapes, last = [], [], None
    for run in re.findall(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0d]+", (text or "").encode()):
        h = hashed(run, SOLID, lower=False)
        if re.match(rb"[A-Za-z0-9\x80-\xff]", run):
            tokens.append(h)
            shapes.append(9 if h == last else shape_of(run))
            last = h
        else:
            tokens.append(mixed(h, 1))
            shapes.append(mixed(h, 2))
    out = []
    for i in range(len(tokens)):
        out += [mixed(tokens[i], 31), mixed(shapes[i], 32)]
        if i:
            pair = mixed(shapes[i] ^ mixed(shapes[i - 1], 33), 34)
            out += [mixed(tokens[i] ^ mixed(tokens[i - 1], 35), 36), pair]
            if i > 1:
                out.append(mixed(pair ^ mixed(shapes[i - 2], 37), 38))
    return Counter(g % quality.BUCKETS for g in out)


def log_model(counts):
    total = sum(counts.values()) + quality.SMOOTHING * quality.BUCKETS
    return lambda bucket: math.log((counts[bucket] + quality.SMOOTHING) / total)


def test_importance_matches_plain_counts(spark, documents, prose):
    texts = prose(12, seed=4, sizes=(1, 25))
    texts += ["Go go go Stop. STOP?! 12 times, 3x", "çA va ÇA -- va", "", None, "...", "A", texts[2]]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    rows += [rows[3], (None, "no id, no label", "en", "s")]
    good = {1, 3, 5, 12, 14, 15}
    # Ids labelled twice, without a document, without an id.
    labels = spark.createDataFrame([(i, int(i in good), 0) for i in range(16)] + [(3, 1, 0), (99, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    raw, target = Counter(), Counter()
    for i, t, _, _ in rows:
        raw.update(grams_of(t))
        if i in good:
            target.update(grams_of(t))
    of_raw, of_target = log_model(raw), log_model(target)
    expected = sorted(
        (-1 if i is None else i, sum(n * (of_target(b) - of_raw(b)) for b, n in grams_of(t).items())) for i, t, _, _ in rows
    )
    found = quality.resample(documents(rows), labels).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.log_ratio) for r in found)
    assert [d for d, _ in got] == [d for d, _ in expected]
    assert [x for _, x in got] == pytest.approx([x for _, x in expected], abs=1e-7)


# --- toxicity -------------------------------------------------------------------------------------
def buckets_of(word):
    """Of the n-grams of a word between its marks, repeats included."""
    code = [1, *word, 2]
    out = []
    for n in tx.GRAMS:
        for i in range(len(code) - n + 1):
            run = code[i]
            for k in range(2, n + 1):
                run = (mixed(run, k) + code[i + k - 1]) % 2**64
            out.append(mixed(run, n) % tx.BUCKETS)
    return out


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def score_of(text, model):
    found = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode())
    bags = [[float(model.value[b]) for b in buckets_of(w)] for w in found]
    means = [sum(b) / len(b) if b else 0.0 for b in bags]
    logits = []
    for i in range(0, len(means), tx.WINDOW):
        window = means[i : i + tx.WINDOW]
        logits.append(sum(window) / len(window) + model.bias)
    high = sum(map(sigmoid, logits))
    top = max(-8.0, min(8.0, max(logits, default=-8.0)))
    x = (1, top, math.log1p(high), high / max(len(logits), 1), math.log1p(len(logits)) / 4)
    return sigmoid(sum(a * float(b) for a, b in zip(x, model.weights, strict=True)))


def test_toxicity_scores_match_plain_counts(documents, prose):
    rng = np.random.default_rng(3)
    model = tx.Model((rng.standard_normal(tx.BUCKETS) * 6).astype(np.float32), -0.4, np.array([-0.3, 0.5, 0.8, -1.1, 0.6]))
    texts = prose(6, seed=2, sizes=(1, 30)) + ["", None, "?!", "a", "A b C", "É ça Va É", "odd number words", "same same same"]
    # A long text: its windows all count.
    texts.append(" ".join(prose(40, seed=7, sizes=(60, 70))))
    df = documents([(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {r.doc_id: r.toxic_score for r in tx.score(df, model).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(score_of(t, model), abs=1e-9), t


def test_toxicity_starts_from_counts_of_documents():
    texts = ["bad bad worse", "bad day", "good day", "fine day good"] * 9
    toxic = np.array([True, True, False, False] * 9)
    learn = np.arange(len(texts)) % 5 > 0
    w = tx.words(texts, ALNUM)
    _, which, back = np.unique(hashes(w), return_index=True, return_inverse=True)
    bucket, count = tx._listed(w, which)
    got = tx._contrast(w.doc, back, count, np.cumsum(count), bucket, toxic, learn)
    held = [{b for word in t.encode().split() for b in buckets_of(word)} for t in texts]
    a, b = int((toxic & learn).sum()), int((~toxic & learn).sum())
    for gram in set().union(*held):
        x = sum(gram in h for h, t, on in zip(held, toxic, learn, strict=True) if on and t)
        y = sum(gram in h for h, t, on in zip(held, toxic, learn, strict=True) if on and not t)
        p = (x + y) / (a + b)
        z = (x / a - y / b) / math.sqrt(max(p * (1 - p), 1e-9) * (1 / a + 1 / b))
        assert got[gram] == pytest.approx(math.copysign(max(abs(z) - 3, 0), z), abs=1e-9)
    assert (got > 0).any() and (got < 0).any()
