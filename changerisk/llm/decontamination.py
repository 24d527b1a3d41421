"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton is built over the items' words; it holds every run of words of every item. Training
words are streamed through it, which gives the longest run ending at each word that some item
holds. Runs of the window length mark a document's words as hit, with the items that hold them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from changerisk.llm.blocks import ALNUM, cut, hashes, words
from changerisk.llm.shared import map_exactly, set_aside

#: Words of a window.
WINDOW = 10
#: Item words of one automaton; more items go into further ones, through which texts pass in turn.
SHARD_WORDS = 200_000

_PAIR = np.uint64(0x9E3779B97F4A7C15)


class Automaton:
    """Generalised suffix automaton over word hashes of some items."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends = []
        for _, seq in items:
            last = 0
            for word in seq:
                last = self._extend(last, word)
            ends.append(last)
        # Items by state: those whose runs of a window's length end in the state's runs.
        self.items: list[set[str]] = [set() for _ in self.length]
        #: Short items by the state of their whole text, with their lengths.
        self.short: dict[int, set[str]] = {}
        for (name, seq), end in zip(items, ends, strict=True):
            if len(seq) < window:
                if seq:
                    self.short.setdefault(end, set()).add(name)
                continue
            state = 0
            for word in seq:
                state = self.next[state][word]
                up = state
                while up > 0 and self.length[up] >= window and name not in self.items[up]:
                    self.items[up].add(name)
                    up = self.link[up]
        self.short_size = {end: self.length_of(items, end, ends) for end in self.short}
        self.least = min([window, *self.short_size.values()])
        pairs = {(a, b) for _, seq in items for a, b in zip(seq, seq[1:], strict=False)}
        self.words = np.unique(np.fromiter((w for _, seq in items for w in seq), np.uint64))
        self.pairs = np.unique(np.fromiter((_pair(np.uint64(a), np.uint64(b)) for a, b in pairs), np.uint64, len(pairs)))

    @staticmethod
    def length_of(items, end, ends) -> int:
        return next(len(seq) for (_, seq), e in zip(items, ends, strict=True) if e == end and seq)

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """The state for the runs of ``q`` that are one word longer than those of ``p``."""
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, self.next[last][word], word)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, self.next[p][word], word)
        return new

    def stream(self, seq: list[int]) -> Iterator[tuple[int, int, int]]:
        """(position, state, longest match ending there) for each word."""
        state = match = 0
        for i, word in enumerate(seq):
            while state and word not in self.next[state]:
                state = self.link[state]
                match = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                match += 1
            yield i, state, match

    def spans(self, seq: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """[from, to) of the words hit by a window, and the items whose windows occur."""
        found, names = [], set()
        for i, state, match in self.stream(seq):
            if match < self.least:
                continue
            if match >= self.window:
                up = state
                while self.length[self.link[up]] >= self.window:
                    up = self.link[up]
                found.append((i + 1 - self.window, i + 1))
                names |= self.items[up]
            up = state
            while self.short and up > 0:
                # A short item's state may be matched by less than the whole item.
                if up in self.short and match >= self.short_size[up]:
                    found.append((i + 1 - self.short_size[up], i + 1))
                    names |= self.short[up]
                up = self.link[up]
        return found, names


def _pair(a, b):
    with np.errstate(over="ignore"):
        return a * _PAIR ^ (b + (b >> np.uint64(7)))


def _member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(x), bool)
    at = np.searchsorted(of, x)
    at[at == len(of)] = 0
    return of[at] == x


def candidate_runs(h: np.ndarray, doc: np.ndarray, a: Automaton) -> Iterator[tuple[int, int]]:
    """Runs of words in which each word, and each pair of neighbours, stands in some item."""
    known = _member(h, a.words)
    # A word continues a run if the pair of it and the one before stands in an item.
    on = known.copy()
    if len(h):
        on[0] = False
        on[1:] &= known[:-1] & (doc[1:] == doc[:-1]) & _member(_pair(h[:-1], h[1:]), a.pairs)
    starts = np.flatnonzero(known & ~on)
    after = np.concatenate((on, [False]))
    stops = np.flatnonzero((known | on) & ~after[1:]) + 1
    keep = stops - starts >= a.least
    yield from zip(starts[keep].tolist(), stops[keep].tolist(), strict=True)


def shards(benchmark: DataFrame, window: int = WINDOW, size: int = SHARD_WORDS) -> Iterator[Automaton]:
    """Automata of the items, of about ``size`` words each; rows come to the driver one by one."""
    items: list[tuple[str, list[int]]] = []
    held = 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).toLocalIterator():
        w = words([row.t], ALNUM)
        if len(w.start):
            items.append(("" if row.i is None else row.i, [int(x) for x in hashes(w)]))
            held += len(w.start)
        if held >= size:
            yield Automaton(items, window)
            items, held = [], 0
    if items:
        yield Automaton(items, window)


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``hit_words``, ``hit_spans`` and ``hit_items``.

    ``hit_words``: words of the text; ``hit_spans``: [from, to) of words inside an occurrence of a
    window of an item, joined where they touch, as a flat list; ``hit_items``: sorted ids, as
    strings, of the items with occurring windows. A window: ``window`` consecutive words of an item,
    or a whole shorter item. A null or blank text has no words, an item without words no window; an
    empty benchmark hits nothing; rows that repeat are marked alike; extra columns stay, but for
    those in ``drop``, which then need not come back from the tasks.
    """
    out = docs.select(
        "*",
        F.lit(0).cast("long").alias("hit_words"),
        F.array().cast("array<int>").alias("hit_spans"),
        F.array().cast("array<string>").alias("hit_items"),
    )
    found = list(shards(benchmark, window))
    if not found:
        found = [Automaton([], window)]
    for k, a in enumerate(found):
        left = drop if k == len(found) - 1 else ()
        schema = T.StructType([f for f in out.schema.fields if f.name not in left])
        sent = docs.sparkSession.sparkContext.broadcast(a)

        def step(parts: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for part in parts:
                texts = part["text"].tolist()
                texts = [t if isinstance(t, str) else None for t in texts]
                counts, spans, names = [], part["hit_spans"].tolist(), part["hit_items"].tolist()
                for lo, hi in cut(texts):
                    w = words(texts[lo:hi], ALNUM)
                    h, first = hashes(w), w.firsts()
                    counts += np.diff(first).tolist()
                    for s, e in candidate_runs(h, w.doc, sent.value):
                        new, items = sent.value.spans(h[s:e].tolist())
                        if new:
                            d = int(w.doc[s])
                            shift = s - int(first[d])
                            old = list(spans[lo + d])
                            flat = [*zip(old[::2], old[1::2], strict=True), *((x + shift, y + shift) for x, y in new)]
                            spans[lo + d] = [x for pair in joined(flat) for x in pair]
                            names[lo + d] = sorted({*names[lo + d], *items})
                part["hit_words"], part["hit_spans"], part["hit_items"] = counts, spans, names
                yield part.drop(columns="text")

        out = map_exactly(out, step, schema, ["text", "hit_spans", "hit_items"])
    return out


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch joined."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _hit_count() -> Column:
    """Sum of the spans' lengths: what stands at odd places less what stands at even ones."""
    signed = F.transform("hit_spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x).cast("long"))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    marked = mark(docs.select("doc_id", "text"), benchmark, window, drop=("text",))
    return marked.select(
        "doc_id",
        F.col("hit_words").alias("n_words"),
        _hit_count().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = 0.5) -> DataFrame:
    """``docs`` without the passages that stand in the benchmark.

    Hit spans are cut out of the text, from the first character of their first word to that of the
    word after them; a document of which more than ``coverage`` of the words are hit is dropped.
    Texts without hits stay as they are, null and empty ones too. Rows that repeat are cut alike, and all
    columns stay. An empty benchmark changes nothing; an empty table gives an empty one.
    """
    docs, back = set_aside(docs)
    fields = docs.schema
    marked = mark(docs, benchmark, window)
    kept = marked.where(_hit_count() <= F.col("hit_words") * F.lit(coverage))

    def step(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i, spans in enumerate(part["hit_spans"]):
                if len(spans):
                    part.iat[i, part.columns.get_loc("text")] = without(part["text"].iat[i], list(spans))
            yield part[["_at", "text"]]

    return back(map_exactly(kept, step, fields, ["text", "hit_spans"]))


def without(text: str, spans: list[int]) -> str:
    w = words([text], ALNUM)
    raw = text.encode("utf-8", "replace")
    out, at = [], 0
    for s, e in zip(spans[::2], spans[1::2], strict=True):
        out.append(raw[at : w.start[s]])
        at = int(w.start[e]) if e < len(w.start) else len(raw)
    return b"".join([*out, raw[at:]]).decode()
