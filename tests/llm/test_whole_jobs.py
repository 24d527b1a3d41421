"""Operators look at all of their input: nothing of it is left out by a sample, a prefilter or a quota."""

import numpy as np

from changerisk.llm import lm, quality
from changerisk.llm.blocks import ALNUM, hashes, words
from changerisk.llm.fingerprints import BUCKETS, Fingerprints


def test_every_training_text_trains_the_network(documents, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 4_000)
    rows = [(i, "ka lo mi nu " * (5 + i % 7) + f"w{i}", "en", "s") for i in range(600)]
    df = documents(rows)
    seen, shards, networks, averaged = [], [], [], lm._averaged

    def watched(texts, many, network, *rest):
        seen.extend(texts.select("s").collect())
        shards.append(many)
        networks.append(network)
        return averaged(texts, many, network, *rest)

    monkeypatch.setattr(lm, "_averaged", watched)
    # A start of hardly any text: what is learned comes from the rounds.
    model, _, total = lm.learn(df, sample=2)
    assert sum(len(r.s) // 2 for r in seen) == total == sum(len(t.split()) + 1 for _, t, _, _ in rows)
    assert len(seen) == len(rows) and shards == [-(-total // lm.SHARD)] * lm.ROUNDS and shards[0] > 1
    _, _, sym, _, size = model.coded(["ka lo mi nu " * 8])
    trained = model.recurrent(sym, size)[0] / size[0]
    model.network = networks[0]
    assert trained > model.recurrent(sym, size)[0] / size[0] + 1


def test_rows_of_texts_leave_none_out():
    flat = np.arange(1, 1001, dtype=np.int16)
    rows, before = lm._rows_of(flat, 0)
    assert rows[rows >= 0].tolist() == flat.tolist()
    assert before.tolist() == [0, *rows[:-1, -1].tolist()]


def test_few_band_terms_that_repeat_are_compared_by_all_terms(prose):
    band = [f"band{i}" for i in range(20)]
    inside = np.zeros(BUCKETS, bool)
    inside[(hashes(words(band, ALNUM)) % np.uint64(BUCKETS)).astype(np.int64)] = True
    one, two = prose(2, seed=3, sizes=(300, 300), syllables=("qua", "xe", "zy", "pf", "gh", "wu", "jo", "vi"))
    often = " band1 band2" * 100
    got = Fingerprints.of([one + often, one + often + " odd", two + often, two + " " + " ".join(band)], inside)
    assert got.band.count.tolist() == [2, 2, 2, 20]
    assert got.text[0] != got.text[2]  # other texts with the same few band terms
    near, far, mixed = got.likeness(np.array([0, 0, 2]), got, np.array([1, 2, 3]))
    assert near > 0.5 > far
    # One side has many band terms: both are compared by all their terms.
    assert mixed > 0.3


def test_quality_takes_the_good_documents_of_its_own_input(spark, documents, prose):
    good = list(enumerate(prose(300, seed=5, sizes=(20, 80))))
    junk = [(1000 + i, " ".join(w.upper() + "!!" for w in t.split())) for i, t in enumerate(prose(60, seed=6, sizes=(20, 80)))]
    # Most documents that the labels call bad went in an earlier stage, so that the share of good ones is larger here.
    gone = [(5000 + i, 0, 0) for i in range(300)]
    labels = spark.createDataFrame([(d, int(d < 1000), 0) for d, _ in good + junk if d % 3] + gone, "doc_id long, quality int, toxic int")
    df = documents([(d, t, "en", "s") for d, t in good + junk])
    kept = {r.doc_id for r in quality.keep_good(df, labels).collect()}
    assert sum(d in kept for d, _ in good) > 0.99 * len(good)
    assert sum(d in kept for d, _ in junk) < 0.1 * len(junk)
