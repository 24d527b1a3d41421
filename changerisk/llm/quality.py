"""Quality selection by importance resampling.

Two generative models over hashed n-grams are counted: one of target texts, those that labels call
good, one of the raw texts, all documents. A document's importance is the logarithm of the ratio of
its likelihoods; Gumbel noise is added and the k largest are taken, which samples k documents
without replacement, in proportion to importance.

The n-grams are words and pairs of words as written, and runs of up to three shapes: how a word is
capitalised, whether it repeats the one before, or a mark itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from changerisk.llm.blocks import SOLID, cut, hashes, mix, words
from changerisk.llm.mixing import BITS, budget_cuts
from changerisk.llm.shared import map_exactly, hash_fraction, hashed_sample, set_aside, stored

#: Buckets of hashed n-grams.
BUCKETS = 1 << 16
#: About so many labelled documents make the target model.
TARGET_SAMPLE = 8_000
#: Added to each bucket's count.
SMOOTHING = 1.0
#: Taken beyond the share of good labels, so that noise at the edge costs few good documents.
SLACK = 0.01
#: Importances beyond this many nats, either way, tie.
_LIMIT = float(1 << 20)
#: Steps a unit of the square root of log_ratio, for the histogram of labelled rows.
_PLACES = 64

_U = np.uint64
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LOWERS = np.zeros(256, bool)
_LOWERS[0x61:0x7B] = True
_LOWERS[0x80:] = True
_DIGITS = np.zeros(256, bool)
_DIGITS[0x30:0x3A] = True
_WORD = _UPPER | _LOWERS | _DIGITS
_MARK = SOLID & ~_WORD


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each n-gram."""
    w, m = words(texts, _WORD, lower=False), words(texts, _MARK, lower=False)
    start = np.concatenate((w.start, m.start))
    order = np.argsort(start, kind="stable")
    token = np.concatenate((hashes(w), mix(hashes(m), 1)))[order]
    doc = np.concatenate((w.doc, m.doc))[order]
    shape = np.concatenate((_shapes(w).astype(_U), mix(hashes(m), 2)))[order]
    word = np.concatenate((np.ones(len(w.start), bool), np.zeros(len(m.start), bool)))[order]
    # A word that is the last word again, whatever marks stand between.
    at = np.flatnonzero(word)
    again = at[1:][(token[at[1:]] == token[at[:-1]]) & (doc[at[1:]] == doc[at[:-1]])]
    shape[again] = 9
    found, where = [mix(token, 31), mix(shape, 32)], [doc, doc]
    if len(token) > 1:
        on = doc[1:] == doc[:-1]
        pair = mix(shape[1:] ^ mix(shape[:-1], 33), 34)
        found += [mix(token[1:] ^ mix(token[:-1], 35), 36)[on], pair[on]]
        where += [doc[1:][on]] * 2
        on = doc[2:] == doc[:-2]
        found.append(mix(pair[1:] ^ mix(shape[:-2], 37), 38)[on])
        where.append(doc[2:][on])
    return np.concatenate(where), (np.concatenate(found) % _U(BUCKETS)).astype(np.int64)


def _shapes(w) -> np.ndarray:
    """0 lower case, 1 capitalised, 2 capitals, 3 digits, 4 other."""
    if not len(w.start):
        return np.zeros(0, np.int64)
    count = lambda kind: (lambda run: run[w.end] - run[w.start])(np.concatenate(([0], np.cumsum(kind[w.data]))))
    up, low, digit, size = count(_UPPER), count(_LOWERS), count(_DIGITS), w.end - w.start
    first = _UPPER[w.data[w.start]]
    return np.select([low == size, first & (up == 1), (up > 0) & (low + digit < up), digit == size], [0, 1, 2, 3], 4)


def _texts(column: pd.Series) -> list[str | None]:
    return [t if isinstance(t, str) else None for t in column]


def _tallied(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(BUCKETS, np.int64)
    for part in parts:
        texts = _texts(part["text"])
        for lo, hi in cut(texts):
            total += np.bincount(features(texts[lo:hi])[1], minlength=BUCKETS)
    used = np.flatnonzero(total)
    yield pd.DataFrame({"bucket": used, "n": total[used]})


def _model(docs: DataFrame) -> np.ndarray:
    """Log probability of each bucket; what reaches the driver has a row per bucket at most."""
    counts = docs.select("text").mapInPandas(_tallied, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.full(BUCKETS, SMOOTHING)
    for r in counts:
        total[r.bucket] += r.n
    return np.log(total / total.sum())


def importance(docs: DataFrame, labels: DataFrame, sample: int = TARGET_SAMPLE, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with log_ratio: log of the likelihood under the target over that under the raw model.

    The target model counts about ``sample`` documents labelled with quality 1, the raw model all
    documents. Null and empty texts have ratio 0; with no good label the target is uniform. Rows
    that repeat count as often and are judged alike. Extra columns stay, but for those in ``drop``.
    """
    good = labels.where("quality = 1").select("doc_id").distinct()
    # At most about ``sample`` ids of eight bytes.
    chosen = F.broadcast(hashed_sample(good, [], sample, good["doc_id"]))
    raw = docs.select("doc_id", "text")
    ratio = (_model(raw.join(chosen, "doc_id", "left_semi")) - _model(raw)).astype(np.float64)
    sent = docs.sparkSession.sparkContext.broadcast(ratio)
    kept = [c for c in docs.columns if c not in drop]

    def step(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = _texts(part["text"])
            sums: list[float] = []
            for lo, hi in cut(texts):
                doc, bucket = features(texts[lo:hi])
                sums += np.bincount(doc, sent.value[bucket], minlength=hi - lo).tolist()
            yield part[["_at"]].assign(log_ratio=sums)

    return map_exactly(docs, step, docs.select(*kept, F.lit(0.0).alias("log_ratio")).schema, ["text"])


def good_share(labels: DataFrame) -> float:
    """Share of quality 1 among the labels and SLACK; 1 if there are none."""
    share = labels.where(F.col("quality").isNotNull()).agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    return 1.0 if share is None else min(1.0, share + SLACK)


def own_share(scored: DataFrame, labels: DataFrame) -> float:
    """Share of the rows of ``scored`` above the border of log_ratio between its labelled good and bad ones.

    The border has the fewest labelled rows on the wrong side, good and bad weighing the same in all;
    where several places do, it is the middle of the first run of them. An id with labels of both kinds
    counts for neither. Without good labels in the input, or without bad ones, all rows are above it.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    marks = marks.where("low = high").select("doc_id", (F.col("low") == 1).alias("good"))
    # Places of log_ratio: steps of a signed square root, so that the rows of the histogram have a bound.
    place = F.round(F.signum("log_ratio") * F.sqrt(F.least(F.abs("log_ratio"), F.lit(_LIMIT))) * _PLACES).cast("long")
    placed = stored(scored.select("doc_id", place.alias("place")))
    counts = placed.join(marks, "doc_id").groupBy("place").agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))
    found = counts.orderBy("place").collect()
    place, good, bad = (np.array([r[n] for r in found], np.float64) for n in ("place", "good", "bad"))
    if not good.sum() or not bad.sum():
        return 1.0
    # Wrong if the border is below place i: good ones under it, bad ones from it on.
    wrong = np.concatenate(([0], np.cumsum(good))) / good.sum() + (bad.sum() - np.concatenate(([0], np.cumsum(bad)))) / bad.sum()
    i = int(wrong.argmin())
    if i == 0:
        border = place[0]
    elif i == len(place):
        border = place[-1] + 1
    else:
        border = (place[i - 1] + place[i]) / 2
    return float(placed.agg(F.avg((F.col("place") >= float(border)).cast("double"))).first()[0])


def gumbel_cut(scored: DataFrame, share: float) -> DataFrame:
    """``scored`` with ``selected``: the largest ``share`` of all rows by log_ratio + noise.

    ``noise`` must be there. The cut is found by histograms, not by sorting; ties at it go together.
    """
    key = F.greatest(F.lit(-_LIMIT), F.least(F.lit(_LIMIT), F.col("log_ratio") + F.col("noise")))
    place = F.floor((F.lit(_LIMIT) - key) * F.lit(float(1 << BITS) / (2 * _LIMIT) * (1 - 2.0**-20))).cast("long")
    placed = scored.select("*", place.alias("_place"))
    rows = placed.select(F.lit(None).cast("string").alias("group"), F.col("_place").alias("key"), F.lit(1).cast("long").alias("weight"))
    budget = rows.groupBy("group").agg((F.count("*") * F.lit(float(share))).alias("budget"))
    found = budget_cuts(rows, budget).first()  # one group, one number; none without rows
    return placed.select(*scored.columns, (F.col("_place") <= F.lit(-1 if found is None else found["cut"])).alias("selected"))


def gumbel_noise(*identity) -> Column:
    u = hash_fraction(*identity, F.lit("gumbel")) * (1 - 2.0**-40) + 2.0**-49
    return -F.log(-F.log(u))


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, sample: int = TARGET_SAMPLE) -> DataFrame:
    """doc_id, log_ratio, noise, selected: ``share`` of all documents (that of good labels if None).

    Each row has a row. Null and empty texts have ratio 0 and are drawn by their noise alone. Rows that
    repeat an id with its text have the same noise, and ties at the cut go together. A null id is an id
    like others, but has no label. An empty table gives an empty result; without labels all are selected.
    """
    keyed = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("same"))
    scored = importance(keyed, labels, sample, drop=("text",))
    noisy = stored(scored.select("doc_id", "log_ratio", gumbel_noise(F.col("doc_id"), F.col("same")).alias("noise")))
    return gumbel_cut(noisy, good_share(labels) if share is None else share)


def keep_selected(docs: DataFrame, labels: DataFrame, share: float | None = None, sample: int = TARGET_SAMPLE) -> DataFrame:
    """The selected rows of ``docs``, with all their columns; nulls, ties and repeats as in ``resample``."""
    docs, back = set_aside(docs)
    noise = gumbel_noise(F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    noisy = stored(importance(docs, labels, sample).select("*", noise.alias("noise")))
    return back(gumbel_cut(noisy, good_share(labels) if share is None else share).where("selected"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = TARGET_SAMPLE) -> DataFrame:
    """As many rows of ``docs``, sampled by importance, as lie on the good side of its own labelled rows' border.

    All columns stay. Without good or without bad labels among the ids of ``docs`` all rows are kept, null and
    empty texts too; otherwise nulls, ties and repeats are as in ``resample``. An empty table gives an empty one.
    """
    docs, back = set_aside(docs)
    noise = gumbel_noise(F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    noisy = stored(importance(docs, labels, sample).select("*", noise.alias("noise")))
    return back(gumbel_cut(noisy, own_share(noisy, labels)).where("selected"))
