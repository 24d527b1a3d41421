"""Toxicity scores: subword bags averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams, a window of a few words the average of its words' bags,
and a softmax over the window's average embedding tells clean from toxic. Labels are of documents:
while training, a document is represented by the windows that now look most toxic. A last logistic
step turns the windows' logits into one score; it is fitted on documents kept from the training.

After training, an n-gram's embedding counts only by its product with the softmax's weights, so a
score costs one number per n-gram, and what is sent to the tasks has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from changerisk.llm.blocks import ALNUM, Words, cut, hashes, mix, words
from changerisk.llm.shared import map_exactly, hashed_sample, remainder

#: About so many labelled documents of each class are learned from, and so many windows of each.
SAMPLE = 2_000
SAMPLE_WINDOWS = 1024
#: Words of a window, sizes of n-grams in bytes, buckets of n-grams, size of an embedding.
WINDOW = 2
GRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 17
DIM = 8
EPOCHS = 12
RATE = 0.2
#: Logit of an n-gram for each standard error by which its documents stand out at the start.
START = 4.0
#: A document is predicted toxic from this score on.
THRESHOLD = 0.3

_U = np.uint64


def _texts(column: pd.Series) -> list[str | None]:
    return [t.lower() if isinstance(t, str) else None for t in column]


def grams(w: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``which``, bucket) of each n-gram of some words; words are enclosed in marks."""
    size = (w.end - w.start)[which]
    stop = np.cumsum(size + 2)
    owner = np.repeat(np.arange(len(which)), size + 2)
    code = np.empty(len(owner), _U)
    inner = np.arange(len(owner)) - (stop - size - 2)[owner]
    middle = (inner > 0) & (inner <= size[owner])
    code[middle] = w.data[(w.start[which][owner] + inner - 1)[middle]]
    code[inner == 0], code[inner == size[owner] + 1] = 1, 2
    who, found = [], []
    run = code
    for n in range(2, max(GRAMS) + 1):
        run = mix(run[:-1], n) + code[n - 1 :]
        if n in GRAMS:
            on = owner[n - 1 :] == owner[: len(owner) - n + 1]
            who.append(owner[: len(owner) - n + 1][on])
            found.append(mix(run[on], n) % _U(BUCKETS))
    return np.concatenate(who), np.concatenate(found).astype(np.int64)


def window_of(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Number of each word's window, and the document of each window."""
    if not len(w.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = w.firsts()
    inside = (np.arange(len(w.start)) - first[w.doc]) % WINDOW
    new = inside == 0
    return np.cumsum(new) - 1, w.doc[new]


@dataclass
class Model:
    """Logit of each n-gram, that of a window without any, and the document step."""

    value: np.ndarray
    bias: float
    weights: np.ndarray

    def window_logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        w = words(texts, ALNUM)
        if not len(w.start):
            return np.zeros(0, np.int64), np.zeros(0)
        _, which, back = np.unique(hashes(w), return_index=True, return_inverse=True)
        who, bucket = grams(w, which)
        count = np.maximum(np.bincount(who, minlength=len(which)), 1)
        score = (np.bincount(who, self.value[bucket], minlength=len(which)) / count)[back]
        number, doc = window_of(w)
        return doc, np.bincount(number, score) / np.bincount(number) + self.bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        doc, logit = self.window_logits(texts)
        return 1 / (1 + np.exp(-np.clip(summaries(doc, logit, len(texts)) @ self.weights, -30, 30)))


def summaries(doc: np.ndarray, logit: np.ndarray, docs: int) -> np.ndarray:
    """Per document: 1, its largest logit, how many windows look toxic, their share, its length."""
    n = np.bincount(doc, minlength=docs)
    top = np.full(docs, -8.0)
    np.maximum.at(top, doc, logit)
    high = np.bincount(doc, 1 / (1 + np.exp(-np.clip(logit, -30, 30))), minlength=docs)
    return np.column_stack((np.ones(docs), top.clip(-8, 8), np.log1p(high), high / np.maximum(n, 1), np.log1p(n) / 4))


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Train on documents; ``weight``: how many documents of the corpus each one stands for."""
    rng = np.random.default_rng(7)
    value, weights = np.zeros(BUCKETS, np.float32), np.zeros(5)
    prior = float((toxic * weight).sum() / max(weight.sum(), 1e-9)) if len(texts) else 0.0
    weights[0] = np.log((prior + 1e-6) / (1 - prior + 1e-6))
    w = words(texts, ALNUM)
    if not len(w.start) or toxic.all() or not toxic.any():
        return Model(value, 0.0, weights)
    _, which, back = np.unique(hashes(w), return_index=True, return_inverse=True)
    bucket, gram_count = _listed(w, which)
    gram_end = np.cumsum(gram_count)
    number, doc = window_of(w)
    word_doc = doc[number].astype(np.int32)
    win_count = np.bincount(number)
    win_start = np.concatenate(([0], np.cumsum(win_count)))
    back = back.astype(np.int32)
    del w, which, number

    held = rng.random(len(texts)) < 0.2
    table = (rng.standard_normal((BUCKETS, DIM)) / DIM).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    out[:, 1] = rng.standard_normal(DIM) / np.sqrt(DIM)
    seen = np.full((BUCKETS, 1), 1e-6, np.float32)
    seen_out, seen_bias = np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)

    def logits() -> np.ndarray:
        v = table @ (out[:, 1] - out[:, 0])
        # A zero at the end, for words without n-grams there.
        sums = np.add.reduceat(np.append(v[bucket], np.float32(0)), gram_end - gram_count)
        score = np.where(gram_count > 0, sums / np.maximum(gram_count, 1), 0).astype(np.float32)[back]
        return np.add.reduceat(score, win_start[:-1]) / win_count + (bias[1] - bias[0])

    learn = ~held
    # Start where n-grams stand in more toxic documents than chance allows, or in fewer.
    table[:, 0] = _contrast(word_doc, back, gram_count, gram_end, bucket, toxic, learn) * START
    out[0] = (-0.5, 0.5)
    many = 2
    for _ in range(epochs):
        at = np.lexsort((-logits(), doc))
        first = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(texts)))))
        place = np.arange(len(doc)) - first[doc[at]]
        picked = at[(place < many) & learn[doc[at]]]
        rng.shuffle(picked)
        # Classes count alike.
        share = toxic[doc[picked]].mean()
        for lo in range(0, len(picked), 256):
            wins = picked[lo : lo + 256]
            y = toxic[doc[wins]].astype(np.int64)
            cost = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32) / len(wins)
            sizes = win_count[wins]
            row = np.repeat(np.arange(len(wins)), sizes)
            word = back[_spread(win_start[wins], sizes)]
            n = gram_count[word]
            gram_row = np.repeat(row, n)
            coef = np.repeat(1.0 / (sizes[row] * np.maximum(n, 1)), n).astype(np.float32)
            ids = bucket[_spread((gram_end - gram_count)[word], n)]
            bag = np.empty((len(wins), DIM), np.float32)
            for k in range(DIM):
                bag[:, k] = np.bincount(gram_row, table[ids, k] * coef, minlength=len(wins))
            z = bag @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(wins)), y] -= 1
            p *= cost[:, None]
            g_out, g_bias, g_bag = bag.T @ p, p.sum(axis=0), p @ out.T
            used, spot = np.unique(ids, return_inverse=True)
            g = np.empty((len(used), DIM), np.float32)
            for k in range(DIM):
                g[:, k] = np.bincount(spot, g_bag[gram_row, k] * coef, minlength=len(used))
            seen[used, 0] += (g * g).sum(axis=1)
            table[used] -= RATE * g / np.sqrt(seen[used])
            seen_out += g_out**2
            out -= RATE * g_out / np.sqrt(seen_out)
            seen_bias += g_bias**2
            bias -= RATE * g_bias / np.sqrt(seen_bias)
    x = summaries(doc, logits(), len(texts))
    rows = held if toxic[held].any() and not toxic[held].all() else learn
    weights = _logistic(x[rows], toxic[rows].astype(float), weight[rows])
    return Model((table @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]), weights)


def _listed(w: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of some words, word by word, and how many each has; some words at a time."""
    buckets, counts = [], []
    for lo in range(0, len(which), 1 << 15):
        part = which[lo : lo + (1 << 15)]
        who, bucket = grams(w, part)
        buckets.append(bucket[np.argsort(who, kind="stable")].astype(np.int32))
        counts.append(np.bincount(who, minlength=len(part)))
    return np.concatenate(buckets), np.concatenate(counts)


def _contrast(word_doc: np.ndarray, word: np.ndarray, gram_count: np.ndarray, gram_end: np.ndarray, bucket: np.ndarray, toxic: np.ndarray, learn: np.ndarray) -> np.ndarray:
    """Standard errors by which toxic documents hold an n-gram more often than clean ones, less 3."""
    held = {True: np.zeros(BUCKETS, np.int64), False: np.zeros(BUCKETS, np.int64)}
    ends = np.searchsorted(word_doc, np.arange(len(toxic) + 1))
    for d in np.flatnonzero(learn):
        own = np.unique(word[ends[d] : ends[d + 1]])
        own = np.unique(bucket[_spread((gram_end - gram_count)[own], gram_count[own])])
        held[bool(toxic[d])][own] += 1
    a, b = max((toxic & learn).sum(), 1), max((~toxic & learn).sum(), 1)
    p = (held[True] + held[False]) / (a + b)
    z = (held[True] / a - held[False] / b) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / a + 1 / b))
    return np.sign(z) * np.maximum(np.abs(z) - 3, 0)


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    stop = np.cumsum(size)
    return np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - size - start, size)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    weight = weight / weight.mean()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
    return w


def _thinned(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words of each text; of a longer one, SAMPLE_WINDOWS windows from all over it."""
    for part in parts:
        texts = []
        for t in _texts(part["text"]):
            w = words([t], ALNUM)
            n = -(-len(w.start) // WINDOW)
            spots = range(n) if n <= SAMPLE_WINDOWS else np.sort(np.random.default_rng(len(w.start)).choice(n, SAMPLE_WINDOWS, False)).tolist()
            texts.append(" ".join(w.text(i) for s in spots for i in range(s * WINDOW, min((s + 1) * WINDOW, len(w.start)))))
        yield pd.DataFrame({"text": texts, "toxic": part["toxic"], "weight": part["weight"]})


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on about ``sample`` labelled documents of each class; at most that reaches the driver.

    A document with several labels counts as toxic if one says so; null labels do not count.
    """
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = F.broadcast(hashed_sample(known, ["toxic"], sample, known["doc_id"]))
    weight = F.lit(1.0)
    for toxic, n in sizes.items():
        weight = F.when(F.col("toxic") == toxic, F.lit(max(1.0, n / sample))).otherwise(weight)
    found = docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "toxic", weight.alias("weight"))
    rows = found.mapInPandas(_thinned, "text string, toxic int, weight double").toPandas()
    rows = rows.sort_values(["text", "toxic"], kind="stable")  # the same order in every run
    return fit(rows["text"].tolist(), rows["toxic"].to_numpy() == 1, rows["weight"].to_numpy())


def score(docs: DataFrame, model: Model, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with toxic_score, from 0 to 1.

    Null, empty and wordless texts get the score of a document without windows. Rows that repeat
    are judged alike; extra columns stay, but for those in ``drop``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in drop]

    def step(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = _texts(part["text"])
            found = [x for lo, hi in cut(texts, 1 << 19) for x in sent.value.scores(texts[lo:hi]).tolist()]
            yield part[["_at"]].assign(toxic_score=found)

    return map_exactly(docs, step, docs.select(*kept, F.lit(0.0).alias("toxic_score")).schema, ["text"])


def assess(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from labels of rows with ``crc32`` mod 4 not 2.

    Each row has a row, and equal texts have equal scores. Null and empty texts are scored as texts without
    words. An empty table gives an empty result. Extra columns are ignored.
    """
    held = remainder("doc_id", 4) == 2
    model = learn(docs.where(~held), labels.where(remainder("doc_id", 4) != 2), sample)
    scored = score(docs.select("doc_id", "text"), model, drop=("text",))
    return scored.select(
        "doc_id",
        held.alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
