"""Language, quality, toxicity and language-model operators: held-out results and edge cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from changerisk.llm import language, lm, quality, toxicity

SYLLABLES = {
    "en": ("tha", "er", "on", "ing", "ble", "the", "st"),
    "de": ("sch", "ung", "ver", "keit", "ein", "ich", "ü"),
    "fr": ("eau", "oi", "é", "tion", "ç", "ment", "la"),
}
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture
def speakers(prose):
    rows = []
    for k, (lang, syllables) in enumerate(SYLLABLES.items()):
        rows += [(1000 * (k + 1) + i, t, lang, "s") for i, t in enumerate(prose(60, seed=k, sizes=(2, 60), syllables=syllables))]
    return rows


def test_language_of_held_out_documents(documents, speakers, edge_rows):
    rows = [r for r in edge_rows if r[0] is None or r[0] < 5] + speakers
    got = language.identify(documents(rows)).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    pred = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(pred[i].lang_pred == "und" and pred[i].score == 0 for i in (1, 2, 3, 4))
    right = [pred[i].lang_pred == lang for i, _, lang, _ in speakers if pred[i].held_out]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_distance_is_out_of_place(speakers):
    """Against a plain count and rank of runs."""
    def ranked(text):
        text = "".join(c.lower() if c.isalpha() else " " for c in text)
        n = Counter()
        for w in text.split():
            p = f" {w} "
            n.update(w)
            n.update(p[i : i + 2] for i in range(len(p) - 1))
            n.update(p[i : i + 3] for i in range(len(p) - 2))
        return n

    code = lambda run: sum(ord(c) << 21 * (len(run) - 1 - i) for i, c in enumerate(run))
    rows, places = [], {}
    for lang in ("de", "en"):
        n = ranked(" ".join(t for _, t, x, _ in speakers if x == lang))
        order = sorted(n, key=lambda r: (-n[r], code(r)))[: language.PLACES]
        places[lang] = {r: i for i, r in enumerate(order)}
        rows += [(lang, code(r), i) for r, i in places[lang].items()]
    model = language.Profiles(rows)
    text = "Ein Schlauch, the Ringing ver-keit 中"
    far, runs = model.distances([None, text, "12"], model.numbers())
    assert runs.tolist() == [0, len(ranked(text)), 0]
    # Ties have an order of their own; counted once, they differ by places that tie.
    n = ranked(text)
    plain = {x: sum(abs(p[r] - i) if r in p else language.PLACES for i, r in enumerate(sorted(n, key=lambda r: -n[r]))) for x, p in places.items()}
    for k, lang in enumerate(model.langs):
        assert abs(far[1][k] - plain[lang]) <= len(n) * len(n) / 2
        assert far[1][k] <= len(n) * language.PLACES


def test_language_without_training(documents, edge_rows):
    rows = [(d, t, None, s) for d, t, _, s in edge_rows]
    assert {r.lang_pred for r in language.identify(documents(rows)).collect()} == {"und"}
    assert language.identify(documents([])).count() == 0
    df = documents(edge_rows)
    kept = language.keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {7}


def test_quality_keeps_clean_documents(spark, documents, prose, edge_rows):
    good = list(enumerate(prose(300, seed=5, sizes=(20, 80))))
    junk = [(1000 + i, " ".join(w.upper() + "!!" for w in t.split())) for i, t in enumerate(prose(60, seed=6, sizes=(20, 80)))]
    labels = spark.createDataFrame([(d, int(d < 1000), None) for d, _ in good + junk if d % 3] + [(5, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    df = documents([(d, t, "en", "s") for d, t in good + junk])
    got = {r.doc_id: r for r in quality.resample(df, labels).collect()}
    assert sum(got[d].selected for d, _ in good) > 0.99 * len(good)
    assert sum(got[d].selected for d, _ in junk) < 0.1 * len(junk)
    kept = quality.keep_selected(df, labels)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d in got if got[d].selected)


def test_gumbel_cut_takes_the_largest(spark):
    rng = random.Random(3)
    rows = [(i, rng.gauss(0, 30), rng.gauss(0, 1)) for i in range(500)] + [(900, 1e9, 0.0), (901, -1e9, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, log_ratio double, noise double")
    got = {r.doc_id for r in quality.gumbel_cut(df, 0.25).where("selected").collect()}
    top = sorted(rows, key=lambda r: -(r[1] + r[2]))
    assert got == {r[0] for r in top[: round(0.25 * len(rows))]} or len(got ^ {r[0] for r in top[: round(0.25 * len(rows))]}) <= 1


def test_quality_edges(spark, documents, edge_rows):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.resample(documents(edge_rows), labels).collect()
    assert len(got) == len(edge_rows) and all(r.selected for r in got)
    assert quality.resample(documents([]), labels).count() == 0


def test_toxicity_finds_misspelled_words(spark, documents, prose, edge_rows):
    rng = random.Random(8)
    insults = ["grobnik", "fuzzwort", "skelmpox"]
    rows, labels = [], []
    for i, t in enumerate(prose(500, seed=7, sizes=(20, 90))):
        toxic = i % 6 == 0
        w = t.split()
        for _ in range(3 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(insults))
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, int(toxic)))
    twisted = [(1000 + i, t + " grobnikk and fuzzworts " + t, "en", "s") for i, t in enumerate(prose(20, seed=12, sizes=(20, 60)))]
    table = spark.createDataFrame(labels + [(3, 1, None), (None, None, 1)], "doc_id long, quality int, toxic int")
    df = documents(rows + twisted + edge_rows)
    got = toxicity.assess(df, table).collect()
    assert len(got) == len(rows) + 20 + len(edge_rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id >= 10]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert sum(r.predicted for r in got if r.doc_id is not None and r.doc_id >= 1000) >= 18


def test_toxicity_without_labels(spark, documents, edge_rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.assess(documents(edge_rows), none).collect()
    assert len(got) == len(edge_rows) and not any(r.predicted for r in got)
    assert toxicity.assess(documents([]), none).count() == 0


def test_counts_and_scores_of_the_language_model(documents, edge_rows, prose, monkeypatch):
    # A head of few words, so that rarer ones go through the join.
    monkeypatch.setattr(lm, "HEAD", 40)
    rows = edge_rows + [(100 + i, f"The {t}", "en", "s") for i, t in enumerate(prose(120, seed=2, sizes=(5, 60)))]
    got = lm.score_held_out(documents(rows)).collect()
    assert len(got) == len(rows)
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]
    held = lambda d: zlib.crc32(str(d).encode() if d is not None else b"") % 5 == 1
    counts = Counter(w for d, t, _, _ in rows if not held(d) for w in split(t))
    total, kinds = sum(counts.values()), len(counts)
    want = sorted(
        (held(d), len(split(t)), sum(counts[w] > 0 for w in split(t)), total, round(sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in split(t)), 6))
        for d, t, _, _ in rows
    )
    assert sorted((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm.score_held_out(documents([])).count() == 0


def test_probabilities_add_up_and_gradients_fit():
    net = lm.Network.fresh()
    n = lm.CLASSES * lm.MEMBERS + lm.TAILS
    state = np.random.default_rng(0).standard_normal((1, lm.HIDDEN)).astype(np.float32)
    p = np.exp(net.log_probability(np.repeat(state, n, axis=0), np.arange(n)))
    assert abs(p.sum() - 1) < 1e-4
    # A cycle is learned.
    stream = np.tile(np.array([0, 5, 9, 700, 5, 1030]), (8, 40))
    trained = lm.train(stream, 0, epochs=8, rate=0.02)
    model = lm.Model(np.array([lm.END]), np.array([1]), np.array([0]), 0.0, np.zeros(lm.TAILS), trained)
    text = np.array([5, 9, 700, 5, 1030, 0])
    per_word = model.recurrent(text, np.array([6]))[0] / 6
    assert per_word > np.log(0.3)


def test_state_runs_on_across_windows():
    model = lm.Model(np.array([lm.END]), np.array([1]), np.array([0]), 0.0, np.zeros(lm.TAILS))
    rng = np.random.default_rng(5)
    sizes = np.array([1, 200, 3, 97])
    symbols = rng.integers(0, lm.CLASSES * lm.MEMBERS + lm.TAILS, sizes.sum())
    together = model.recurrent(symbols, sizes)
    at = np.concatenate(([0], np.cumsum(sizes)))
    for i in range(4):
        state, last, total = np.zeros((1, lm.HIDDEN), np.float32), np.array([model.start]), 0.0
        for s in symbols[at[i] : at[i + 1]]:
            state, _ = model.network.step(state, last)
            last = np.array([s])
            total += model.network.log_probability(state, last)[0]
        assert abs(total - together[i]) < 1e-2 * max(1, sizes[i] / 10)


def test_every_letter_of_a_profile_counts():
    letters = [chr(c) for lo in (0x0430, 0x4E00, 0xAC00) for c in range(lo, lo + 400) if chr(c).isalpha() and chr(c).lower() == chr(c)]
    parts = [letters[i : i + 300] for i in range(0, 1200, 300)][:3]
    code = lambda r: sum(ord(c) << 21 * (len(r) - 1 - i) for i, c in enumerate(r))
    model = language.Profiles([(f"l{k}", code(x), i) for k, part in enumerate(parts) for i, x in enumerate(part)])
    assert len(model.known) == 900
    other = "".join(chr(c) for c in range(0x0E01, 0x0E0F))
    far, runs = model.distances([other, "".join(parts[2][:5])] * 3, model.numbers())
    # Runs of a script that no profile has are as far from all profiles as can be.
    assert (far[0] == runs[0] * language.PLACES).all()
    assert far[1].argmin() == 2 and (far[::2] == far[0]).all()


def test_distance_is_exact_with_ties_by_code():
    text = "abba ab ba cab"
    runs = {}
    for word in text.split():
        padded = f" {word} "
        for size in (1, 2, 3):
            for i in range(len(padded) - size + 1):
                r = padded[i : i + size]
                if r.strip() and " " not in r[1:-1] and r != " ":
                    runs[r] = runs.get(r, 0) + 1
    number = lambda c: 1 if c == " " else 3 + "abc".index(c)
    key = lambda r: sum(number(c) << 8 * (len(r) - 1 - i) for i, c in enumerate(r))
    order = sorted(runs, key=lambda r: (-runs[r], key(r)))
    code = lambda r: sum(ord(c) << 21 * (len(r) - 1 - i) for i, c in enumerate(r))
    profile = ["a", "b", "ab", "c", " a", "ba", "a ", "bb", "abb"]
    model = language.Profiles([("x", code(r), i) for i, r in enumerate(profile)])
    far, n = model.distances([text], model.numbers())
    assert n[0] == len(runs)
    assert far[0][0] == sum(abs(profile.index(r) - i) if r in profile else language.PLACES for i, r in enumerate(order))


def test_texts_run_in_groups_and_large_weights_are_shifted(monkeypatch):
    rng = np.random.default_rng(4)
    model = lm.Model(np.array([lm.END]), np.array([1]), np.array([0]), 0.0, np.zeros(lm.TAILS))
    sizes = rng.integers(1, 40, 50)
    symbols = rng.integers(0, lm.CLASSES * lm.MEMBERS + lm.TAILS, sizes.sum()).astype(np.int16)
    whole, most = model.recurrent(symbols, sizes), []
    step = lm.Network.step
    monkeypatch.setattr(lm.Network, "step", lambda net, state, last: (most.append(len(state)), step(net, state, last))[1])
    monkeypatch.setattr(lm, "BESIDE", 7)
    monkeypatch.setattr(lm, "GATHERED", 16)
    assert np.allclose(model.recurrent(symbols, sizes), whole, rtol=1e-5) and max(most) == 7
    weight, bias = np.full((lm.HIDDEN, 2), 50, np.float32), np.array([0, 1], np.float32)
    state = np.ones((3, lm.HIDDEN), np.float32)
    assert np.allclose(lm._softmax(state, weight, bias), [[1 / (1 + np.e), np.e / (1 + np.e)]] * 3, atol=1e-5)


def test_all_classes_of_symbols_are_trained_together(monkeypatch):
    rng, calls, softmax = np.random.default_rng(6), [], lm._softmax
    monkeypatch.setattr(lm, "_softmax", lambda *x: (calls.append(x[0].shape), softmax(*x))[1])
    streams = rng.integers(0, lm.CLASSES * lm.MEMBERS + lm.TAILS, (32, lm.STEPS)).astype(np.int16)
    lm.train(streams, 0, epochs=1)
    # One window: a call for the classes, and one for the members of all of them.
    assert len(calls) == 2


def test_gradients_of_classes_and_members_are_those_of_each_row(monkeypatch):
    monkeypatch.setattr(lm, "NEAR", 7)
    monkeypatch.setattr(lm, "BLOCK", 4)
    rng, net = np.random.default_rng(7), lm.Network.fresh()
    state = rng.uniform(-1, 1, (60, lm.HIDDEN)).astype(np.float32)
    y = np.concatenate((rng.integers(0, 100, 40), [lm.CLASSES * lm.MEMBERS - 1], lm.CLASSES * lm.MEMBERS + np.arange(19)))
    kind = lm._kinds(y)
    want = [np.zeros_like(p) for p in (net.classes, net.class_bias, net.members, net.member_bias, state)]
    for i, (h, c, m) in enumerate(zip(state, kind, y % lm.MEMBERS, strict=True)):
        p = lm._softmax(h[None], net.classes, net.class_bias)[0] - np.eye(lm.CLASSES + lm.TAILS)[c]
        want[0] += np.outer(h, p)
        want[1] += p
        want[4][i] += net.classes @ p
        if c < lm.CLASSES:
            p = lm._softmax(h[None], net.members[c], net.member_bias[c])[0] - np.eye(lm.MEMBERS)[m]
            want[2][c] += np.outer(h, p)
            want[3][c] += p
            want[4][i] += net.members[c] @ p
    weight, bias, by_state = lm._class_gradients(net, state, kind)
    members, member_bias, more, known = lm._member_gradients(net, state, kind, y % lm.MEMBERS)
    by_state[known] += more
    for got, w in zip((weight, bias, members, member_bias, by_state), want, strict=True):
        assert np.allclose(got, w, atol=1e-5)
    only_tail = lm._member_gradients(net, state[41:], kind[41:], y[41:] % lm.MEMBERS)
    assert not only_tail[0].any() and not only_tail[1].any() and len(only_tail[2]) == len(only_tail[3]) == 0


def test_hashes_are_found_by_their_range(monkeypatch):
    rng = np.random.default_rng(8)
    ends = np.array([np.iinfo(np.int64).min, np.iinfo(np.int64).max, lm.END, -1, 0])
    for bits, many in ((20, 3000), (3, 3000), (20, 0), (1, 1)):
        monkeypatch.setattr(lm, "RANGES", bits)
        head = np.unique(np.concatenate((rng.integers(-(2**62), 2**62, many), ends[2 : 2 + many])))
        model = lm.Model(head, np.ones(len(head), np.int64), np.full(len(head), -1), 0.0, np.zeros(lm.TAILS))
        asked = np.concatenate((head, head + 1, rng.integers(-(2**62), 2**62, 500), ends))
        place = {h: i for i, h in enumerate(head.tolist())}
        assert model._places(asked).tolist() == [place.get(h, -1) for h in asked.tolist()]
