"""Document fingerprints by I-Match over randomised lexicon subsets.

Of a document's distinct terms those count whose share of documents lies in a band: common enough to
be no slip of one text, rare enough to tell texts apart. Several random subsets of the lexicon each
keep some of them, sorted; a subset's hash stays the same as long as no term that it keeps comes or
goes. Subsets are drawn so small that about one term of the document at hand is kept by each: the
rate is a power of two next to one over the number of its terms, its half and its quarter, so that
texts of like length are compared at common rates.

Terms are counted by hash bucket, so the lexicon sent to the tasks has a fixed size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from changerisk.llm.blocks import ALNUM, cut, hashes, mix, words
from changerisk.llm.shared import map_exactly, stored

#: Shares of documents between which a term counts.
BAND = (0.005, 0.05)
#: Buckets of terms, and subsets of the lexicon.
BUCKETS = 1 << 18
SUBSETS = 16
#: Rates of a section: next to one term of the document per subset, a half, a quarter.
RATES = 3
#: With fewer distinct terms in the band than FEW both kinds of terms are hashed; if either of two texts
#: has less than half of it, both are compared by all their terms.
FEW = 16

_U = np.uint64


def _texts(column: pd.Series) -> list[str]:
    return [t if isinstance(t, str) else "" for t in column]


def _document_counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(BUCKETS, np.int64)
    rows = 0
    for part in parts:
        texts = _texts(part["text"])
        rows += len(texts)
        for lo, hi in cut(texts):
            w = words(texts[lo:hi], ALNUM)
            held = np.unique(w.doc.astype(np.int64) * BUCKETS + (hashes(w) % _U(BUCKETS)).astype(np.int64))
            total += np.bincount(held % BUCKETS, minlength=BUCKETS)
    used = np.flatnonzero(total)
    # The number of documents goes along as bucket -1.
    yield pd.DataFrame({"bucket": np.append(used, -1), "n": np.append(total[used], rows)})


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> np.ndarray:
    """Which buckets of terms lie in the band, by their share of all documents."""
    counts = stored(docs.select("text").mapInPandas(_document_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")))
    total = counts.where("bucket = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    inside = counts.where((F.col("bucket") >= 0) & F.col("n").between(total * band[0], total * band[1]))
    out = np.zeros(BUCKETS, bool)
    out[[r.bucket for r in inside.select("bucket").collect()]] = True  # a row per bucket at most
    return out


@dataclass
class Section:
    """Hashes of subsets at each rate, by document; ``rate`` is -1 for documents without terms."""

    rate: np.ndarray
    count: np.ndarray
    subset: np.ndarray

    @staticmethod
    def of(doc: np.ndarray, term: np.ndarray, docs: int) -> Section:
        """``doc``, ``term``: sorted and distinct."""
        count = np.bincount(doc, minlength=docs)
        rate = np.where(count > 0, np.log2(np.maximum(count, 1)).astype(np.int64), -1)
        out = np.zeros((docs, RATES, SUBSETS), _U)
        if len(doc):
            begin = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            value = mix(term, 41)
            for s in range(SUBSETS):
                draw = mix(term, 50 + s)
                for k in range(RATES):
                    kept = draw >> _U(1) < (_U(1) << (_U(63) - (rate[doc] + k).astype(_U)))
                    out[doc[begin], k, s] = np.add.reduceat(np.where(kept, value, _U(0)), begin)
        return Section(rate, count, np.where(out == 0, _U(0), mix(out, 42) % _U(0xFFFF) + _U(1)).astype(np.uint16))

    def text(self, i: int, name: str) -> str:
        return f"{name}{self.rate[i]}:" + self.subset[i].astype(">u2").tobytes().hex()

    def likeness(self, i: np.ndarray, other: Section, j: np.ndarray) -> np.ndarray:
        """Share of equal hashes, of the subsets that keep a term of either text, at common rates."""
        same, either = np.zeros(len(i)), np.zeros(len(i))
        for k in range(RATES):
            for m in range(RATES):
                on = (self.rate[i] >= 0) & (other.rate[j] >= 0) & (self.rate[i] + k == other.rate[j] + m)
                a, b = self.subset[i, k], other.subset[j, m]
                same += on * ((a == b) & (a > 0)).sum(axis=1)
                either += on * ((a > 0) | (b > 0)).sum(axis=1)
        return same / np.maximum(either, 1)


@dataclass
class Fingerprints:
    band: Section
    every: Section
    text: list[str]
    #: document and hash of each word
    doc: np.ndarray
    word: np.ndarray

    @staticmethod
    def of(texts: list[str], inside: np.ndarray) -> Fingerprints:
        w = words(texts, ALNUM)
        h = hashes(w)
        on = inside[(h % _U(BUCKETS)).astype(np.int64)]
        band = _section(w.doc[on], h[on], len(texts))
        few = band.count < FEW
        every = _section(w.doc[few[w.doc]], h[few[w.doc]], len(texts))
        names = [
            (band.text(i, "b") if band.rate[i] >= 0 else "") + (every.text(i, "a") if every.rate[i] >= 0 else "")
            for i in range(len(texts))
        ]
        return Fingerprints(band, every, names, w.doc, h)

    def by_every(self, i: np.ndarray) -> Section:
        """All terms of at least the documents ``i``: of those with many terms in the band they are hashed only here."""
        if (self.band.count[i] < FEW).all():
            return self.every
        need = np.zeros(len(self.text), bool)
        need[i] = True
        return _section(self.doc[need[self.doc]], self.word[need[self.doc]], len(self.text))

    def likeness(self, i: np.ndarray, other: Fingerprints, j: np.ndarray) -> np.ndarray:
        by_band = (self.band.count[i] >= FEW // 2) & (other.band.count[j] >= FEW // 2)
        found = self.band.likeness(i, other.band, j)
        rest = np.flatnonzero(~by_band)
        if len(rest):
            a, b = i[rest], j[rest]
            found[rest] = self.by_every(a).likeness(a, other.by_every(b), b)
        equal = np.array([self.text[a] == other.text[b] for a, b in zip(i, j, strict=True)], bool)
        return np.where(equal, 1.0, found)


def _section(doc: np.ndarray, h: np.ndarray, docs: int) -> Section:
    """Of the distinct terms of each document, in order."""
    pairs = np.unique(np.stack((doc.astype(_U), h), axis=1), axis=0) if docs >= 1 << 16 else None
    if pairs is None:
        # 16 bits of the document, 48 of the term.
        key = np.unique(doc.astype(_U) << _U(48) | h >> _U(16))
        return Section.of((key >> _U(48)).astype(np.int64), key & _U((1 << 48) - 1), docs)
    return Section.of(pairs[:, 0].astype(np.int64), pairs[:, 1] >> _U(16), docs)


def fingerprint(docs: DataFrame, inside: np.ndarray) -> DataFrame:
    """``docs`` with fingerprint; a null text counts as empty, and an empty one has an empty fingerprint."""
    sent = docs.sparkSession.sparkContext.broadcast(inside)

    def step(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = _texts(part["text"])
            found = [x for lo, hi in cut(texts) for x in Fingerprints.of(texts[lo:hi], sent.value).text]
            yield part[["_at"]].assign(fingerprint=found)

    return map_exactly(docs, step, docs.select("*", F.lit("").alias("fingerprint")).schema, ["text"])


def _edited(texts: list[str], following: list[str], inside: np.ndarray) -> dict[str, list]:
    """What is asked of each text and the one after it."""
    out: dict[str, list] = {k: [] for k in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
    for lo, hi in cut(texts, 1 << 19):
        own, after = texts[lo:hi], following[lo:hi]
        edited = [t[: len(t) - len(t) // 4] + f[: len(t) // 4] for t, f in zip(own, after, strict=True)]
        # Each text follows the one before it, so that all but one have their fingerprint.
        chain = all(a is b for a, b in zip(own[1:], after, strict=False))
        mine = Fingerprints.of([*own, after[-1]] if chain else own, inside)
        theirs = mine if chain else Fingerprints.of(after, inside)
        changed = Fingerprints.of(edited, inside)
        i = np.arange(hi - lo)
        out["n_chars"] += map(len, own)
        out["edited_sha256"] += [hashlib.sha256(e.encode("utf-8", "replace")).hexdigest() for e in edited]
        out["fingerprint"] += mine.text[: hi - lo]
        out["edited_fingerprint"] += changed.text
        out["near_edited"] += mine.likeness(i, changed, i).tolist()
        out["near_next"] += mine.likeness(i, theirs, i + 1 if chain else i).tolist()
    return out


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_edits(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents are dealt into ranges of ids, so that each meets the next one in its own task; only
    the first and the last of each range are matched between tasks. Rows with equal ids are ordered
    by a hash of their texts and then by them; null ids come first. A single document follows
    itself. Null texts count as empty; two equal fingerprints, empty ones too, have likeness 1. An
    empty table gives an empty result; extra columns are ignored.
    """
    inside = docs.sparkSession.sparkContext.broadcast(lexicon(docs, band))
    kept = docs.select("doc_id", "text", F.xxhash64("text").alias("_same"))
    # Ids pass the tasks as text, so that each stays what it is beside a null.
    ranged = kept.repartitionByRange("doc_id", "_same").sortWithinPartitions("doc_id", "_same", "text").select(F.col("doc_id").cast("string"), "text")

    def step(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = TaskContext.get().partitionId()
        edge = lambda name, doc_id, text: pd.DataFrame({"doc_id": [doc_id], "edge": [name], "place": [place], "text": [text]})
        held_id = held = None
        for part in parts:
            ids, texts = part["doc_id"].tolist(), _texts(part["text"])
            ids = [None if pd.isna(x) else x for x in ids]
            if not texts:
                continue
            if held is None:
                yield edge("first", ids[0], texts[0])
            else:
                ids, texts = [held_id, *ids], [held, *texts]
            if len(texts) > 1:
                yield pd.DataFrame({"doc_id": ids[:-1], "edge": None, "place": place, "text": None} | _edited(texts[:-1], texts[1:], inside.value))
            held_id, held = ids[-1], texts[-1]
        if held is not None:
            yield edge("last", held_id, held)

    def whole(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "edge", "place", "text", *(x.split()[0] for x in _RESULT.split(", "))]
        for part in step(parts):
            part = part.reindex(columns=names).astype(object)
            yield part.where(part.notna(), None)

    found = stored(ranged.mapInPandas(whole, f"doc_id string, edge string, place int, text string, {_RESULT}"))
    # One row per task: which is the next task that has rows; after the last comes the first.
    first = found.where("edge = 'first'").select("place", F.col("text").alias("following"))
    order = Window.orderBy("place")
    turn = first.select("place", F.coalesce(F.lead("place").over(order), F.min("place").over(Window.partitionBy())).alias("next_place"))
    last = found.where("edge = 'last'").select("place", "doc_id", "text").join(turn, "place")
    pairs = last.join(first.withColumnRenamed("place", "next_place"), "next_place").select("doc_id", "text", "following")

    def ends(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"]} | _edited(_texts(part["text"]), _texts(part["following"]), inside.value))

    columns = ["doc_id", *(x.split()[0] for x in _RESULT.split(", "))]
    whole_rows = found.where("edge is null").select(*columns).unionByName(pairs.mapInPandas(ends, f"doc_id string, {_RESULT}"))
    return whole_rows.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
