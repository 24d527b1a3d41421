"""Language identification by rank-order profiles.

A profile lists a language's most frequent runs of one to three letters in order. A document's own
list is compared with each profile by the out-of-place distance: how many places each run stands
away from its place in the profile, and the profile's length for runs that it lacks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from changerisk.llm.blocks import cut
from changerisk.llm.shared import map_exactly, hashed_sample, remainder, set_aside

#: Places of a profile, and of a document's list.
PLACES = 300
#: About so many documents of each language are learned from.
SAMPLE = 2_000
#: Bits of a letter while learning; while comparing, letters have as many as the profiles' letters need.
_CODE = 21
_BLANK = 32


@cache
def _letters() -> np.ndarray:
    """Each code point's lower-case letter, or a blank."""
    out = np.full(0x110000, _BLANK, np.int32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _runs(texts: list[str | None], number: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, run) of all runs; a blank may stand at either end of a run, not within it.

    ``number`` renames letters, blanks among them, to ``bits`` bits.
    """
    coded = [f" {t} ".encode("utf-32-le", "replace") if t else b"" for t in texts]
    code = _letters()[np.frombuffer(b"".join(coded), np.uint32)]
    doc = np.repeat(np.arange(len(texts)), [len(c) // 4 for c in coded])
    solid = code != _BLANK
    keep = solid.copy()
    if len(code):
        # The first blank after a letter, and those before each document's first letter.
        keep[1:] |= solid[:-1] | (doc[1:] != doc[:-1])
        keep[0] = True
    code, doc, solid = code[keep].astype(np.int64), doc[keep], solid[keep]
    if number is not None:
        code = number[code]
    found, where = [code[solid]], [doc[solid]]
    if len(code) > 1:
        on = (doc[1:] == doc[:-1]) & (solid[1:] | solid[:-1])
        pair = code[:-1] << bits | code[1:]
        found.append(pair[on])
        where.append(doc[1:][on])
        if len(code) > 2:
            on = (doc[2:] == doc[:-2]) & solid[1:-1]
            found.append((pair[:-1] << bits | code[2:])[on])
            where.append(doc[2:][on])
    return np.concatenate(where), np.concatenate(found)


def _texts(column: pd.Series) -> list[str | None]:
    return [t if isinstance(t, str) else None for t in column]


def _counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for lang, rows in part.groupby("lang", sort=False):
            texts = _texts(rows["text"])
            for lo, hi in cut(texts):
                run, n = np.unique(_runs(texts[lo:hi], None, _CODE)[1], return_counts=True)
                yield pd.DataFrame({"lang": lang, "run": run, "n": n})


class Profiles:
    """Places of runs by language; runs are kept by the numbers of their letters."""

    def __init__(self, rows: list[tuple[str, int, int]], places: int = PLACES):
        """``rows``: language, run in code points, place from 0."""
        self.places = places
        self.langs = sorted({lang for lang, _, _ in rows})
        split = [[run >> s & (1 << _CODE) - 1 for s in (2 * _CODE, _CODE, 0)] for _, run, _ in rows]
        known = sorted({c for cs in split for c in cs if c and c != _BLANK})
        # 1: a blank, 2: any letter of no profile.
        self.known = np.array(known, np.int64)
        self.bits = (len(known) + 2).bit_length()
        number = self.numbers()
        place: dict[int, dict[str, int]] = {}
        for (lang, _, at), cs in zip(rows, split, strict=True):
            run = 0
            for c in cs:
                run = run << self.bits | (int(number[c]) if c else 0)
            place.setdefault(run, {}).setdefault(lang, at)
        self.runs = np.array(sorted(place), np.int64)
        self.table = np.array([[place[r].get(x, -1) for x in self.langs] for r in self.runs.tolist()], np.int32).reshape(len(self.runs), len(self.langs))

    def numbers(self) -> np.ndarray:
        out = np.full(0x110000, 2, np.int64)
        out[_BLANK] = 1
        out[self.known] = np.arange(3, 3 + len(self.known))
        return out

    def distances(self, texts: list[str | None], number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance of each text from each language, and the runs compared (0: no letter)."""
        n, places, bits = len(texts), self.places, 3 * self.bits
        room = 1 << 63 - bits
        if n > room:  # a document and a run go into one number
            parts = [self.distances(texts[a : a + room], number) for a in range(0, n, room)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        doc, run = _runs(texts, number, self.bits)
        key = np.sort(doc << bits | run)
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(new, len(key)))
        key = key[new]
        doc = key >> bits
        order = np.lexsort((key, -count, doc))
        first = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n))))
        rank = np.arange(len(key)) - first[doc]
        order, rank, doc = order[rank < places], rank[rank < places], doc[rank < places]
        run = key[order] & (1 << bits) - 1
        total = np.zeros((n, len(self.langs)), np.int64)
        if len(run) and len(self.runs):
            at = np.minimum(np.searchsorted(self.runs, run), len(self.runs) - 1)
            place = np.where((self.runs[at] == run)[:, None], self.table[at], -1)
            apart = np.where(place < 0, places, np.abs(place - rank[:, None]))
            begin = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            total[doc[begin]] = np.add.reduceat(apart, begin, axis=0)
        return total, np.bincount(doc, minlength=n)


def learn(docs: DataFrame, sample: int = SAMPLE, places: int = PLACES) -> Profiles:
    """Profiles of the values of ``lang`` of about ``sample`` documents each (fewer if there are fewer).

    Rows without text or language teach nothing. The result has ``places`` rows per language.
    """
    taught = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    picked = hashed_sample(taught, ["lang"], sample, taught["doc_id"], taught["lang"])
    counts = picked.select("lang", "text").mapInPandas(_counted, "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "run")) - 1
    rows = counts.select("lang", "run", place.alias("place")).where(F.col("place") < places).collect()
    return Profiles([(r.lang, r.run, r.place) for r in rows], places)


def predict(docs: DataFrame, profiles: Profiles, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with lang_pred and lang_score.

    A text that is null or has no letter, and any text where no language was learned, is ``und``
    with score 0. Of languages at equal distance the first by name counts. The score is 1 where the
    document's list is the profile, 0 where they share no run. Rows that repeat are judged alike.
    Extra columns stay; those in ``drop`` are left out.
    """
    kept = [c for c in docs.columns if c not in drop]
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    def step(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        number = model.numbers()
        for part in parts:
            texts = _texts(part["text"])
            langs, scores = [], []
            for lo, hi in cut(texts, 1 << 19):
                far, runs = model.distances(texts[lo:hi], number)
                known = (runs > 0) & (len(model.langs) > 0)
                best = far.argmin(axis=1) if len(model.langs) else np.zeros(hi - lo, int)
                least = far.min(axis=1) if len(model.langs) else np.zeros(hi - lo)
                score = np.where(known, 1 - least / np.maximum(runs * model.places, 1), 0.0)
                langs += [model.langs[b] if k else "und" for b, k in zip(best, known, strict=True)]
                scores += score.clip(0, 1).tolist()
            yield part[["_at"]].assign(lang_pred=langs, lang_score=scores)

    return map_exactly(docs, step, docs.select(*kept, F.lit("").alias("lang_pred"), F.lit(0.0).alias("lang_score")).schema, ["text"])


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned where ``crc32`` of the id modulo 3 is not 1.

    Each row has a row, and equal texts have equal predictions. Null, empty and letterless texts are ``und``
    with score 0. Languages at equal distance are decided by code. An empty table gives an empty result.
    Extra columns are ignored.
    """
    held = remainder("doc_id", 3) == 1
    profiles = learn(docs.where(~held), sample)
    judged = predict(docs.select("doc_id", "text"), profiles, drop=("text",))
    return judged.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def keep_identified(docs: DataFrame, sample: int = SAMPLE, least: float = 0.0) -> DataFrame:
    """``docs`` without those of no language: ``und``, or nothing in common with any profile.

    So null, empty and letterless texts go. Rows that repeat stay or go together, and all columns stay. An
    empty table gives an empty one; where nothing can be learned, no row stays.
    """
    docs, back = set_aside(docs)
    judged = predict(docs, learn(docs.where(remainder("doc_id", 3) != 1), sample))
    return back(judged.where((F.col("lang_pred") != "und") & (F.col("lang_score") > least)))
